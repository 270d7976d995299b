"""A query: predicate, sort keys, offset and limit, applied in that order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.paths import source_of


@dataclass(frozen=True)
class SortKey:
    field: str
    ascending: bool = True
    #: None: as the engine sorts, nulls first ascending and last descending
    nulls_first: bool | None = None
    ignore_case: bool = False

    def column(self, source) -> Column:
        c = source.value(self.field).key
        c = F.lower(c) if self.ignore_case else c
        first = self.ascending if self.nulls_first is None else self.nulls_first
        if self.ascending:
            return c.asc_nulls_first() if first else c.asc_nulls_last()
        return c.desc_nulls_first() if first else c.desc_nulls_last()


@dataclass(frozen=True)
class Query:
    predicate: P.Predicate | None = None
    sort: tuple[SortKey, ...] = ()
    offset: int = 0
    limit: int | None = None
    hints: frozenset[str] = frozenset()

    @staticmethod
    def all() -> Query:
        return Query()

    @staticmethod
    def matching(column: Column | Callable[[object], Column]) -> Query:
        """Any boolean column; unknown counts as false."""
        from ..functions.paths import sure

        return Query(column if callable(column) and not isinstance(column, Column) else lambda _: sure(column))

    @staticmethod
    def where(field: str, test: Callable[..., Column], *args) -> Query:
        return Query(lambda source: test(source.value(field), *args))

    def __and__(self, other: Query) -> Query:
        """Both; sort, offset and limit of the left side stay."""
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Query) -> Query:
        return self._with(other, lambda a, b: a | b)

    def _with(self, other: Query, join) -> Query:
        a, b = self.predicate, other.predicate
        true = F.lit
        return replace(
            self, predicate=lambda s: join(a(s) if a else true(True), b(s) if b else true(True))
        )

    def order_by(self, *keys: str | SortKey) -> Query:
        """Sort keys; "-field" sorts downwards."""
        made = [k if isinstance(k, SortKey) else SortKey(k.lstrip("-"), not k.startswith("-")) for k in keys]
        return replace(self, sort=tuple(made))

    def window(self, offset: int = 0, limit: int | None = None) -> Query:
        return replace(self, offset=max(0, offset), limit=None if limit is None else max(0, limit))

    def page(self, number: int, size: int) -> Query:
        """Page number, from 0."""
        return self.window(number * size, size)

    def page_from_one(self, number: int, size: int) -> Query:
        """Page number, from 1."""
        return self.page(max(number, 1) - 1, size)

    def hint(self, *names: str) -> Query:
        """CACHE_RESULT persists the result; hints about indexes and parallelism are for Catalyst to decide and change nothing."""
        known = {"NO_INDEX", "FORCE_INDEX", "PARALLEL", "CACHE_RESULT", "NO_CACHE"}
        if not set(names) <= known:
            raise ValueError(f"unknown hints: {sorted(set(names) - known)}")
        return replace(self, hints=self.hints | set(names))

    def filter(self, df: DataFrame, doc: str | None = None) -> DataFrame:
        """The predicate alone."""
        return df if self.predicate is None else df.where(self.predicate(source_of(df, doc)))

    def apply(self, df: DataFrame, doc: str | None = None) -> DataFrame:
        """Filter, sort, skip, take. Catalyst turns sort and limit into a top-k."""
        out = self.filter(df, doc)
        if self.sort:
            source = source_of(df, doc)
            out = out.orderBy(*[k.column(source) for k in self.sort])
        if self.offset:
            out = out.offset(self.offset)
        out = out if self.limit is None else out.limit(self.limit)
        return out.persist() if "CACHE_RESULT" in self.hints and "NO_CACHE" not in self.hints else out


def _make(test, *fixed):
    return lambda field, *args: Query.where(field, test, *fixed, *args)


eq = _make(P.equals)
ne = _make(P.differs)
gt, gte, lt, lte = ((lambda op: lambda field, x: Query.where(field, P.compare, op, x))(op) for op in ("gt", "gte", "lt", "lte"))
between = _make(P.between)
contains = _make(P.contains)
regex = _make(P.matches)
like = _make(P.like_found)


def is_in(field: str, xs: Sequence[P.Literal]) -> Query:
    return Query.where(field, P.is_in, xs)


def exists(field: str) -> Query:
    return Query(lambda s: s.value(field).present)
