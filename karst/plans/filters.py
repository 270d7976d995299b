"""Filter documents in the style of document stores: ``{"price": {"$gt": 5}, "$or": [...]}``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.paths import Value
from ..functions.predicates import Equality
from .query import Query, SortKey


class FilterError(ValueError):
    """A filter that can't be compiled."""


def _list(op: str, x: object) -> list:
    if not isinstance(x, list):
        raise FilterError(f"{op} needs a list, not {x!r}")
    return x


def _exists(v: Value, x: object) -> Column:
    if not isinstance(x, bool):
        raise FilterError(f"$exists needs true or false, not {x!r}")
    return v.present if x else ~v.present


def _regex(v: Value, x: object) -> Column:
    try:
        return P.matches(v, str(x))
    except ValueError as e:
        raise FilterError(str(e)) from e


#: Operators of one field; unlike plain equality, $ne and $nin hold for missing fields.
OPERATORS = {
    "$eq": lambda v, x: P.equals(v, x, Equality.STRICT),
    "$ne": lambda v, x: ~P.equals(v, x, Equality.STRICT),
    "$gt": lambda v, x: P.compare(v, "gt", x),
    "$gte": lambda v, x: P.compare(v, "gte", x),
    "$lt": lambda v, x: P.compare(v, "lt", x),
    "$lte": lambda v, x: P.compare(v, "lte", x),
    "$in": lambda v, x: P.is_in(v, _list("$in", x)),
    "$nin": lambda v, x: ~P.is_in(v, _list("$nin", x)),
    "$regex": _regex,
    "$exists": _exists,
}


def compile_filter(spec: Mapping | None, source) -> Column:
    """A boolean column for spec; sibling entries must all hold."""
    terms = []
    for key, x in (spec or {}).items():
        if key in ("$and", "$or"):
            parts = [compile_filter(s, source) for s in _list(key, x)]
            terms.append(P.all_of(parts) if key == "$and" else P.any_of(parts))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        elif isinstance(x, Mapping):
            terms += [_field(key, op, operand, source) for op, operand in x.items()]
        else:
            terms.append(P.equals(source.value(key), x))
    return P.all_of(terms)


def _field(field: str, op: str, x: object, source) -> Column:
    if op in ("$and", "$or"):
        return compile_filter({op: x}, source)  # its parts name their own fields
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op}")
    return OPERATORS[op](source.value(field), x)


#: Keys of a request that page through the result.
WINDOW = ("sortField", "sortDir", "limit", "offset")


def to_query(request: Mapping | None) -> Query:
    """A request: filter entries, and the keys of WINDOW; limit and offset of 0 or less don't count."""
    request = dict(request or {})
    window = {k: request.pop(k) for k in WINDOW if k in request}
    out = Query(lambda source: compile_filter(request, source))
    if window.get("sortField"):
        out = out.order_by(SortKey(window["sortField"], str(window.get("sortDir", "asc")).lower() != "desc"))
    limit, offset = int(window.get("limit") or 0), int(window.get("offset") or 0)
    return out.window(max(offset, 0), limit if limit > 0 else None)


def legacy_filter(spec: Mapping) -> Query:
    """``{"$gt": {field: number}}`` with $gt, $lt or $eq; the last field of each operator decides."""
    out = Query.all()
    for op, fields in spec.items():
        if op not in ("$gt", "$lt", "$eq") or not isinstance(fields, Mapping) or not fields:
            raise FilterError(f"unknown operator {op}")
        field, x = list(fields.items())[-1]
        out = out & Query(lambda s, field=field, op=op, x=x: _field(field, op, x, s))
    return out
