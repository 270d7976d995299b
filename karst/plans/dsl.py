"""Text and builder front ends that end in a Query."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.predicates import Equality
from . import query as Q
from .query import Query, SortKey


# --- builder -----------------------------------------------------------------


@dataclass(frozen=True)
class Builder:
    """``select_from("orders").where("total").gt(5)``: one condition on one field."""

    collection: str
    field: str | None = None

    def where(self, field: str) -> Builder:
        return replace(self, field=field)

    def __getattr__(self, name: str):
        tests = {
            "eq": Q.eq, "ne": Q.ne, "gt": Q.gt, "gte": Q.gte, "lt": Q.lt, "lte": Q.lte, "contains": Q.contains,
            "is_in": Q.is_in, "exists": Q.exists, "regex": Q.regex, "like": Q.like, "between": Q.between,
        }
        if name not in tests:
            raise AttributeError(name)
        if self.field is None:
            raise ValueError("where(field) comes first")
        return lambda *args: tests[name](self.field, *args)


def select_from(collection: str) -> Builder:
    return Builder(collection)


# --- strings -----------------------------------------------------------------


def from_text(text: str) -> Query:
    """``field=value``; the value is a string, quotes around it are dropped; no "=" means all."""
    field, found, value = text.partition("=")
    return Q.eq(field.strip(), value.strip().strip("'\"")) if found else Query.all()


_ENTITY_OPS = ("!=", "<>", ">=", "<=", "=", ">", "<")


def where(clause: str, *params: P.Literal) -> Query:
    """``"price >= ? AND name = ?"`` with its parameters; a parameter that isn't given is null.

    Numbers compare as numbers, other values as text if both sides are text; a comparison
    with a missing field is false.
    """
    out, rest = Query.all(), list(params)
    for term in re.split(r"(?i)\s+AND\s+", clause.strip()):
        op = next((o for o in _ENTITY_OPS if o in term), None)
        if op is None:
            raise ValueError(f"no operator in {term!r}")
        field, _, right = term.partition(op)
        if right.strip() != "?":
            raise ValueError(f"{term!r}: the right side must be ?")
        out = out & _entity_term(field.strip(), op, rest.pop(0) if rest else None)
    return out


def _entity_term(field: str, op: str, x: P.Literal) -> Query:
    if op == "=":
        return Q.eq(field, x)
    if op in ("!=", "<>"):
        return Q.ne(field, x)
    name = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]
    if P.is_number(x):
        return Query.where(field, P.compare, name, x)
    return Query(lambda s: (v := s.value(field)).present & ~v.null & P.compare_loose(v, name, x))


def order_of(text: str) -> SortKey:
    """``"price DESC"``"""
    field, _, direction = text.strip().partition(" ")
    return SortKey(field, direction.strip().upper() != "DESC")


# --- mapper ------------------------------------------------------------------


class Mapper:
    """Conditions folded strictly from left to right: ``a or b and c`` is ``(a or b) and c``.

    Equality is loose, nulls sort lowest, like is anchored and ignores case. Rows of
    another entity are left out if the field ``_entity`` says so.
    """

    def __init__(self, entity: str | None = None):
        self.entity, self.terms, self.join, self.negate, self.field = entity, [], "and", False, None
        self.keys: list[SortKey] = []
        self.skip_, self.limit_ = 0, None

    def where(self, field: str) -> Mapper:
        self.field = field
        return self

    def and_(self, field: str) -> Mapper:
        self.join = "and"
        return self.where(field)

    def or_(self, field: str) -> Mapper:
        self.join = "or"
        return self.where(field)

    def not_(self) -> Mapper:
        self.negate = not self.negate
        return self

    def _add(self, test, *args) -> Mapper:
        field, negate = self.field, self.negate
        self.terms.append((self.join, lambda s: ~test(s.value(field), *args) if negate else test(s.value(field), *args)))
        self.negate = False
        return self

    def eq(self, x: P.Literal) -> Mapper:
        return self._add(P.equals, x, Equality.LOOSE)

    def gt(self, x: P.Literal) -> Mapper:
        return self._add(P.compare_loose, "gt", x)

    def gte(self, x: P.Literal) -> Mapper:
        return self._add(P.compare_loose, "gte", x)

    def lt(self, x: P.Literal) -> Mapper:
        return self._add(P.compare_loose, "lt", x)

    def lte(self, x: P.Literal) -> Mapper:
        return self._add(P.compare_loose, "lte", x)

    def between(self, low: P.Literal, high: P.Literal) -> Mapper:
        return self._add(lambda v: P.compare_loose(v, "gte", low) & P.compare_loose(v, "lte", high))

    def like(self, pattern: str) -> Mapper:
        return self._add(P.like_whole, pattern)

    def is_in(self, xs: Sequence[P.Literal]) -> Mapper:
        return self._add(lambda v: P.is_in(v, xs, Equality.LOOSE))

    def order_by(self, *keys: str) -> Mapper:
        self.keys += [SortKey(k.lstrip("-"), not k.startswith("-")) for k in keys]
        return self

    def skip(self, n: int) -> Mapper:
        self.skip_ = max(0, n)
        return self

    def limit(self, n: int) -> Mapper:
        self.limit_ = max(0, n)
        return self

    def delete_from(self, collection):
        """The collection without the rows of the query."""
        return collection.delete(self.query())

    def query(self) -> Query:
        def predicate(s) -> Column:
            out: Column | None = None
            for join, term in self.terms:
                out = term(s) if out is None else (out & term(s) if join == "and" else out | term(s))
            out = F.lit(True) if out is None else out
            if self.entity is not None:
                v = s.value("_entity")
                out = out & (~v.present | (v.has_text & (F.lower(v.text) == self.entity.lower())))
            return out

        return Query(predicate, tuple(self.keys), self.skip_, self.limit_)


# --- derived names -----------------------------------------------------------


def _affix(v, x: str, how: str) -> Column:
    if how == "starts":
        return v.has_text & v.text.startswith(x[:-1] if x.endswith("%") else x)
    return v.has_text & v.text.endswith(x[1:] if x.startswith("%") else x)


def _like_derived(v, x: str) -> Column:
    if x.startswith("%") and x.endswith("%") and len(x) > 1:
        return P.contains(v, x[1:-1])
    if x.endswith("%"):
        return _affix(v, x, "starts")
    if x.startswith("%"):
        return _affix(v, x, "ends")
    return P.equals(v, x)


#: keyword: (parameters, test). The longest keyword that ends a name decides.
KEYWORDS = {
    "IsNotNull": (0, lambda v: v.present), "NotNull": (0, lambda v: v.present),
    "IsNull": (0, lambda v: ~v.present), "Null": (0, lambda v: ~v.present),
    "True": (0, lambda v: P.equals(v, True)), "False": (0, lambda v: P.equals(v, False)),
    "GreaterThanEqual": (1, lambda v, x: P.compare(v, "gte", x)), "GreaterThan": (1, lambda v, x: P.compare(v, "gt", x)),
    "LessThanEqual": (1, lambda v, x: P.compare(v, "lte", x)), "LessThan": (1, lambda v, x: P.compare(v, "lt", x)),
    "After": (1, lambda v, x: P.compare(v, "gt", x)), "Before": (1, lambda v, x: P.compare(v, "lt", x)),
    "Between": (2, P.between),
    "NotIn": (1, lambda v, x: v.present & ~P.is_in(v, x)), "In": (1, P.is_in),
    "NotContaining": (1, lambda v, x: ~P.contains(v, x)), "Containing": (1, P.contains),
    "StartingWith": (1, lambda v, x: _affix(v, x, "starts")), "EndingWith": (1, lambda v, x: _affix(v, x, "ends")),
    "NotLike": (1, lambda v, x: ~_like_derived(v, x)), "Like": (1, _like_derived),
    "Regex": (1, P.matches), "Not": (1, P.differs),
}


def _lowered(v):
    low = F.lower(v.string)
    return replace(v, string=low, text=F.coalesce(low, v.text))


def _fold_case(x):
    return x.lower() if isinstance(x, str) else [_fold_case(y) for y in x] if isinstance(x, list) else x


def _field_name(text: str, fields: Sequence[str]) -> str:
    plain = text.replace("_", "").lower()
    for f in fields:
        if f.replace("_", "").replace(".", "").lower() == plain:
            return f
    return text[:1].lower() + text[1:]


@dataclass(frozen=True)
class Derived:
    """What a method name stands for: find, count, exists or delete, and its query."""

    subject: str
    query: Query


def derived(name: str, *params, fields: Sequence[str] = ()) -> Derived:
    """``findTop3ByPriceGreaterThanAndNameContainingIgnoreCaseOrderByPriceDesc`` and the like.

    Or groups of And terms; all OrderBy keys hold; Top and First limit after sorting.
    fields: the collection's field names, to which parts of the name are matched.
    """
    m = re.fullmatch(r"(find|read|get|query|count|exists|delete|remove)(?:All)?(?:(?:First|Top)(\d*))?[A-Za-z]*?By(.*)", name)
    if not m:
        raise ValueError(f"not a derived query name: {name}")
    subject = {"read": "find", "get": "find", "query": "find", "remove": "delete"}.get(m[1], m[1])
    body, _, order = m[3].partition("OrderBy")
    rest, groups = list(params), []
    for group in re.split(r"Or(?=[A-Z])", body) if body else []:
        terms = []
        for part in re.split(r"And(?=[A-Z])", group):
            part, folded = (part[: -len("IgnoreCase")], True) if part.endswith("IgnoreCase") else (part, False)
            key = max((k for k in KEYWORDS if part.endswith(k) and len(part) > len(k)), key=len, default=None)
            n, test = KEYWORDS[key] if key else (1, P.equals)
            field = _field_name(part[: -len(key)] if key else part, fields)
            if len(rest) < n:
                raise ValueError(f"too few parameters for {name}")
            args = [rest.pop(0) for _ in range(n)]
            if key in ("GreaterThan", "GreaterThanEqual", "LessThan", "LessThanEqual", "After", "Before") and not P.is_number(args[0]):
                raise ValueError(f"{key} needs a number, not {args[0]!r}")
            if folded:
                args = [_fold_case(a) for a in args]
            terms.append(lambda s, f=field, t=test, a=args, low=folded: t(_lowered(s.value(f)) if low else s.value(f), *a))
        groups.append(terms)
    out = Query((lambda s: P.any_of(P.all_of(t(s) for t in g) for g in groups)) if groups else None)
    keys = [SortKey(_field_name(f, fields), d != "Desc") for f, d in re.findall(r"([A-Z][A-Za-z0-9_]*?)(Asc|Desc|$)", order) if f]
    if keys:
        out = out.order_by(*keys)
    if m[2] is not None:
        out = out.window(0, int(m[2] or 1))
    return Derived(subject, out)


# --- by example --------------------------------------------------------------

_STRING_MATCH = {
    "exact": lambda c, x: c == x,
    "starting": lambda c, x: c.startswith(x),
    "ending": lambda c, x: c.endswith(x),
    "containing": lambda c, x: F.contains(c, F.lit(x)),
    "regex": lambda c, x: c.rlike(f"^(?:{x})$"),
}


def by_example(
    probe: Mapping[str, P.Literal],
    match_all: bool = True,
    include_nulls: bool = False,
    string_match: str | Mapping[str, str] = "exact",
    ignore_case: Sequence[str] | bool = (),
) -> Query:
    """Rows that look like probe: all or any of its fields match; null fields are left out unless included."""

    def predicate(s) -> Column:
        terms = []
        for field, x in probe.items():
            v = s.value(field)
            if x is None:
                if include_nulls:
                    terms.append(~v.present | v.null)
            elif isinstance(x, str):
                how = string_match if isinstance(string_match, str) else string_match.get(field, "exact")
                low = ignore_case is True or (ignore_case is not False and field in ignore_case)
                terms.append(v.has_text & _STRING_MATCH[how](F.lower(v.text) if low else v.text, x.lower() if low else x))
            else:
                terms.append(P.equals(v, x))
        return (P.all_of if match_all else P.any_of)(terms) if terms else F.lit(True)

    return Query(predicate)
