"""Predicates on values, as boolean columns that are never null.

Three notions of equality exist side by side and are kept apart:
``TOLERANT`` numbers equal as doubles, all else by type and value;
``STRICT``   integers and fractions differ (5 is not 5.0), all else by type and value;
``LOOSE``    numbers as doubles, or equal texts; missing equals null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from enum import Enum
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import Value, sure

Literal = str | int | float | bool | None
#: From a source of paths to a boolean column.
Predicate = Callable[[object], Column]


class Equality(Enum):
    TOLERANT = "tolerant"
    STRICT = "strict"
    LOOSE = "loose"


def is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equals(v: Value, x: Literal, how: Equality = Equality.TOLERANT) -> Column:
    if x is None:
        if how is Equality.TOLERANT:
            return v.null
        return ~v.present | v.null
    if isinstance(x, bool):
        same = v.has_flag & (v.flag == F.lit(x))
        return same | (v.has_text & (v.text == F.lit(str(x).lower()))) if how is Equality.LOOSE else same
    if is_number(x):
        same = v.has_num & (v.num == F.lit(float(x)))
        if how is Equality.STRICT:
            return same & (v.integral if isinstance(x, int) else ~v.integral)
        return same | (v.has_text & (v.text == F.lit(str(x)))) if how is Equality.LOOSE else same
    if how is Equality.LOOSE:
        return v.has_text & (v.text == F.lit(x))
    return v.has_string & (v.string == F.lit(x))


def differs(v: Value, x: Literal) -> Column:
    """Not equal, and there: a missing field doesn't differ."""
    return v.present & ~equals(v, x)


_COMPARE = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def compare(v: Value, op: str, x: Literal) -> Column:
    """Numeric comparison; false where either side isn't a number."""
    return v.has_num & _COMPARE[op](v.num, F.lit(float(x))) if is_number(x) else F.lit(False)


def compare_loose(v: Value, op: str, x: Literal) -> Column:
    """Comparison in which null and missing sort below everything, numbers as numbers, all else as text."""
    if x is None:
        return {"gt": v.present & ~v.null, "gte": F.lit(True), "lt": F.lit(False), "lte": ~v.present | v.null}[op]
    by_text = _COMPARE[op](v.text, F.lit(str(x)))
    value = F.coalesce(_COMPARE[op](v.num, F.lit(float(x))), by_text) if is_number(x) else by_text
    return F.when(~v.present | v.null, F.lit(op in ("lt", "lte"))).otherwise(sure(value))


def between(v: Value, low: float, high: float) -> Column:
    return compare(v, "gte", low) & compare(v, "lte", high)


def any_of(terms: Iterable[Column]) -> Column:
    return reduce(or_, terms, F.lit(False))


def all_of(terms: Iterable[Column]) -> Column:
    return reduce(and_, terms, F.lit(True))


def is_in(v: Value, xs: Iterable[Literal], how: Equality = Equality.STRICT) -> Column:
    """Membership. Literals of one type become one pushable IN; a null matches stored nulls."""
    xs = list(xs)
    terms = []
    strings = [x for x in xs if isinstance(x, str)]
    if strings and how is not Equality.LOOSE:
        terms.append(v.has_string & v.string.isin(strings))
        xs = [x for x in xs if not isinstance(x, str)]
    for kind, guard in ((int, v.integral), (float, ~v.integral)):
        numbers = [x for x in xs if is_number(x) and isinstance(x, kind)]
        if numbers and how is Equality.STRICT:
            terms.append(v.has_num & v.num.isin([float(x) for x in numbers]) & guard)
            xs = [x for x in xs if not (is_number(x) and isinstance(x, kind))]
    terms += [v.null if x is None and how is not Equality.LOOSE else equals(v, x, how) for x in xs]
    return any_of(terms)


def contains(v: Value, part: str) -> Column:
    return v.has_text & F.contains(v.text, F.lit(part))


def matches(v: Value, pattern: str) -> Column:
    """Regular expression found anywhere."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return v.has_text & v.text.rlike(pattern)


def like_found(v: Value, pattern: str) -> Column:
    """``%`` stands for anything; found anywhere; other characters as in a regular expression."""
    return matches(v, pattern.replace("%", ".*"))


def like_whole(v: Value, pattern: str) -> Column:
    """SQL LIKE with % and _, on the whole text, in any letter case."""
    return v.has_text & v.text.ilike(pattern)
