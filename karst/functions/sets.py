"""Set operations on array columns; a null set is an empty one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _set(members: Column) -> Column:
    return F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))


def _values(values) -> Column:
    return values if isinstance(values, Column) else F.array(*map(F.lit, values)).cast("array<string>")


def size(members: Column) -> Column:
    return F.size(_set(members))


def add(members: Column, values) -> Column:
    return F.array_union(_set(members), _values(values))


def added(members: Column, values) -> Column:
    """How many of the values are new."""
    return F.size(F.array_except(_values(values), _set(members)))


def remove(members: Column, values) -> Column:
    return F.array_except(_set(members), _values(values))


def removed(members: Column, values) -> Column:
    """How many of the values were members."""
    return F.size(F.array_intersect(_set(members), _values(values)))


def contains(members: Column, value) -> Column:
    return F.coalesce(F.array_contains(members, value), F.lit(False))


def inter(*sets: Column) -> Column:
    return reduce(F.array_intersect, map(_set, sets)) if sets else F.array().cast("array<string>")


def union(*sets: Column) -> Column:
    return reduce(F.array_union, map(_set, sets)) if sets else F.array().cast("array<string>")


def diff(first: Column, *rest: Column) -> Column:
    return reduce(F.array_except, map(_set, rest), _set(first))


def move(source: Column, target: Column, value) -> tuple[Column, Column, Column]:
    """(source, target, moved): value goes from one set to the other, if it is a member."""
    hit = contains(source, value)
    return remove(source, [value]), F.when(hit, add(target, [value])).otherwise(_set(target)), hit


def pop(members: Column, n: int = 1) -> tuple[Column, Column]:
    """(n members, the others); the members in sorted order, so that reruns agree."""
    xs = F.array_sort(_set(members))
    return F.slice(xs, 1, n), F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))


def sample(members: Column, n: int, seed: int = 0) -> Column:
    """n members drawn with replacement, by hash, so that reruns agree."""
    xs = F.array_sort(_set(members))
    draw = lambda i: F.get(xs, F.pmod(F.xxhash64(xs, i, F.lit(seed)), F.greatest(F.size(xs), F.lit(1))).cast("int"))
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), draw)).otherwise(xs)
