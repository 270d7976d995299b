"""An aggregation pipeline: lazy stages over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import source_of
from ..plans.query import Query, SortKey


def _numbers(field: str, source) -> Column:
    return source.value(field).num


def aggregate_of(op: str, field: str, source, seq: str | None = None) -> Column:
    """sum and avg of no numbers are 0, min and max null; first and last need an order column."""
    x = _numbers(field, source)
    if op == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if op == "avg":
        return F.coalesce(F.avg(x), F.lit(0.0))
    if op in ("min", "max"):
        return (F.min if op == "min" else F.max)(x)
    if op in ("first", "last"):
        if seq is None:
            raise ValueError(f"{op} needs an order column")
        key = source.value(field).key
        return (F.min_by if op == "first" else F.max_by)(key, F.col(seq))
    if op == "count":
        return F.count("*")
    raise ValueError(f"unknown aggregate {op}")


class Pipeline:
    """Stages apply in the order they are called; nothing runs before an action."""

    def __init__(self, df: DataFrame, id_col: str = "id", doc: str | None = None, seq: str | None = None):
        self.df, self.id_col, self.doc, self.seq = df, id_col, doc, seq

    def _next(self, df: DataFrame, doc: str | None = None) -> Pipeline:
        return Pipeline(df, self.id_col, doc, self.seq)

    def match(self, query: Query) -> Pipeline:
        """The query's predicate; its sort, offset and limit don't count here."""
        return self._next(query.filter(self.df, self.doc), self.doc)

    def group(self, field: str | list[str], **aggregates: tuple[str, str] | str) -> Pipeline:
        """Groups by field; ``total=("sum", "price")``, ``n="count"``.

        Without aggregates a count. The key is named _id, or by field if there are several. Missing
        and null are one group.
        """
        source = source_of(self.df, self.doc)
        keys = [source.value(field).key.alias("_id")] if isinstance(field, str) else [source.value(f).key.alias(f) for f in field]
        out = [
            aggregate_of(*(a if isinstance(a, tuple) else (a, "")), source, self.seq).alias(n)
            for n, a in (aggregates or {"count": "count"}).items()
        ]
        return self._next(self.df.groupBy(*keys).agg(*out))

    def group_own(self, field: str, op: str) -> Pipeline:
        """Groups by field and aggregates the field itself, into a column named like op."""
        return self.group(field, **{op: (op, field)})

    def rollup(self, fields: list[str], **aggregates: tuple[str, str] | str) -> Pipeline:
        source = source_of(self.df, self.doc)
        keys = self.df.select("*", *[source.value(f).key.alias(f"key_{f}") for f in fields])
        out = [aggregate_of(*(a if isinstance(a, tuple) else (a, "")), source, self.seq).alias(n) for n, a in aggregates.items()]
        return self._next(keys.rollup(*[F.col(f"key_{f}").alias(f) for f in fields]).agg(*out))

    def sort(self, *keys: str | SortKey) -> Pipeline:
        source = source_of(self.df, self.doc)
        return self._next(self.df.orderBy(*[k.column(source) for k in Query().order_by(*keys).sort]), self.doc)

    def limit(self, n: int) -> Pipeline:
        return self._next(self.df.limit(n), self.doc)

    def skip(self, n: int) -> Pipeline:
        return self._next(self.df.offset(n), self.doc)

    def project(self, *fields: str) -> Pipeline:
        """The id as ``id`` and the fields."""
        source = source_of(self.df, self.doc)
        names = [f for f in dict.fromkeys(fields) if f not in ("id", self.id_col)]
        return self._next(self.df.select(F.col(self.id_col).alias("id"), *[source.value(f).key.alias(f) for f in names]))

    def stage(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Any other transformation."""
        return self._next(f(self.df), self.doc)

    def _total(self, op: str, field: str, out: str) -> Pipeline:
        return self._next(self.df.agg(aggregate_of(op, field, source_of(self.df, self.doc)).alias(out)))

    def count(self, out: str = "count") -> Pipeline:
        return self._total("count", "", out)

    def sum(self, field: str, out: str = "sum") -> Pipeline:
        return self._total("sum", field, out)

    def avg(self, field: str, out: str = "avg") -> Pipeline:
        return self._total("avg", field, out)

    def min(self, field: str, out: str = "min") -> Pipeline:
        return self._total("min", field, out)

    def max(self, field: str, out: str = "max") -> Pipeline:
        return self._total("max", field, out)

    def execute(self) -> DataFrame:
        return self.df

    def execute_one(self) -> DataFrame:
        return self.df.limit(1)
