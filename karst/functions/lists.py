"""List operations on array columns; indexes from 0, negative ones from the end.

Nulls: a null list is an empty one. All results are new arrays; a list is an ordinary
array column, so a change of many keys is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def length(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def _values(values) -> Column:
    return values if isinstance(values, Column) else F.array(*map(F.lit, values))


def push_left(items: Column, values) -> Column:
    """Each value goes to the front in turn, so the last one given ends up first."""
    return F.concat(F.reverse(_values(values)), _list(items))


def push_right(items: Column, values) -> Column:
    return F.concat(_list(items), _values(values))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, length(items) - 1)


def without_first(items: Column) -> Column:
    return F.slice(_list(items), F.lit(2), F.greatest(length(items) - 1, F.lit(0)))


def without_last(items: Column) -> Column:
    return F.slice(_list(items), F.lit(1), F.greatest(length(items) - 1, F.lit(0)))


def move_last(source: Column, target: Column) -> tuple[Column, Column]:
    """(source, target) after the last element of source went to the front of target; an empty source changes nothing."""
    moved = F.when(length(source) > 0, F.concat(F.array(last(source)), _list(target))).otherwise(target)
    return without_last(source), moved


def _from_start(i: int, n: Column) -> Column:
    return F.lit(i) if i >= 0 else n + i


def _cut(items: Column, start: Column, end: Column) -> Column:
    """Elements start to end, both included; the bounds lie within the list or end is before start."""
    return F.slice(_list(items), start + 1, F.greatest(end - start + 1, F.lit(0)))


def range_(items: Column, start: int, end: int, clamp: bool = True) -> Column:
    """Elements start to end, both included.

    clamp: a start past the end means the last element, an end before the start of the
    list the first; without it both give an empty list.
    """
    n = length(items)
    low, high = F.greatest(_from_start(start, n), F.lit(0)), _from_start(end, n)
    if clamp:
        low, high = F.least(low, n - 1), F.greatest(F.least(high, n - 1), F.lit(0))
    else:
        high = F.least(high, n - 1)
    return F.when((n == 0) | (low > high), F.array().cast("array<string>")).otherwise(
        _cut(items, F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))
    )


def trim(items: Column, start: int, end: int) -> Column:
    """Keeps elements start to end; a start past the end leaves nothing."""
    return range_(items, start, end, clamp=False)


def index(items: Column, i: int) -> Column:
    """Element i, or null."""
    n = length(items)
    at = _from_start(i, n)
    return F.when((at >= 0) & (at < n), F.get(items, F.greatest(at, F.lit(0))))


def set_at(items: Column, i: int, value: str) -> Column:
    """Element i replaced; out of range is an error."""
    n = length(items)
    at = _from_start(i, n)
    changed = F.transform(_list(items), lambda x, j: F.when(j == at, F.lit(value)).otherwise(x))
    return F.when((at >= 0) & (at < n), changed).otherwise(F.raise_error(F.lit("index out of range")).cast("array<string>"))


def remove(items: Column, count: int, value: str) -> Column:
    """Without value: all of them (0), the first count, or the last -count."""
    xs = _list(items)
    if count == 0:
        return F.array_remove(xs, value)
    if count < 0:
        return F.reverse(remove(F.reverse(xs), -count, value))
    places = F.slice(F.filter(F.transform(xs, lambda x, j: F.when(x == value, j)), lambda j: j.isNotNull()), 1, count)
    return F.filter(xs, lambda _, j: ~F.array_contains(places, j))


def insert(items: Column, pivot: str, value: str, before: bool = True) -> Column:
    """value beside the first pivot; unchanged if there is none."""
    at = F.array_position(_list(items), pivot).cast("int")
    place = F.when(at > 0, at + (0 if before else 1)).otherwise(F.lit(1))
    return F.when(at > 0, F.array_insert(_list(items), place, F.lit(value))).otherwise(items)
