"""Aggregates over rows: the row with the least value, coerced sums, first rows of groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import source_of


def coerced(field: str, df: DataFrame, doc: str | None = None) -> tuple[Column, Column]:
    """(present, number): numeric strings parse, null and anything else is 0."""
    v = source_of(df, doc).value(field)
    return v.present, F.coalesce(v.num, v.string.try_cast("double"), F.lit(0.0))


def row_with(df: DataFrame, field: str, largest: bool, seq: str, doc: str | None = None) -> DataFrame:
    """The whole row with the least or largest value of field; the first by seq among ties.

    A top-1, not a sort.
    """
    present, x = coerced(field, df, doc)
    order = x.desc() if largest else x.asc()
    return df.where(present).orderBy(order, F.col(seq).asc()).limit(1)


def total(df: DataFrame, field: str, doc: str | None = None) -> DataFrame:
    """sum and avg over the rows that have field; what isn't a number counts as 0."""
    present, x = coerced(field, df, doc)
    return df.where(present).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(x), F.lit(0.0)).alias("avg"))


def counts_by(df: DataFrame, field: str, doc: str | None = None) -> DataFrame:
    """(value, count) over the rows that have field."""
    v = source_of(df, doc).value(field)
    return df.where(v.present).groupBy(v.key.alias("value")).agg(F.count("*").alias("count"))


def grouped(df: DataFrame, key: Column | Callable[[DataFrame], Column], members: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(value, rows): the rows of each group as an ordered array. A group must fit in memory; see counts_by."""
    k = key(df) if callable(key) and not isinstance(key, Column) else key
    rest = [m for m in members if m not in order]
    return df.groupBy(k.alias("value")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))


def distinct_rows(df: DataFrame, field: str, seq: str, doc: str | None = None) -> DataFrame:
    """The first row by seq for each value of field.

    min_by combines on the map side, so a frequent value isn't gathered in one task as a window would.
    """
    v = source_of(df, doc).value(field)
    whole = F.struct(*df.columns)
    return df.where(v.present).groupBy(v.key.alias("value_")).agg(F.min_by(whole, F.col(seq)).alias("row")).select("row.*")


def distinct_values(df: DataFrame, field: str, doc: str | None = None) -> DataFrame:
    v = source_of(df, doc).value(field)
    return df.where(v.present).select(v.key.alias("value")).distinct()


def result(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Named aggregates in the order given, as one row."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()])


def first_row(df: DataFrame, seq: str, last: bool = False) -> DataFrame:
    return df.orderBy(F.col(seq).desc() if last else F.col(seq).asc()).limit(1)


def ordered(df: DataFrame, field: str, seq: str, ascending: bool = True, doc: str | None = None) -> DataFrame:
    """By the coerced number; ties in the order of seq."""
    _, x = coerced(field, df, doc)
    return df.orderBy(x.asc() if ascending else x.desc(), F.col(seq).asc())


def floor_rank_percentiles(df: DataFrame, field: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The value at place floor(n * q), from 0, of the sorted values, for each q, as p50, p95, ...

    Equal values are counted first, so only distinct values are ranked.
    """
    keys = list(by)
    counted = df.where(F.col(field).isNotNull()).groupBy(*keys, F.col(field).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("x")
    places = counted.withColumn("hi", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "all", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    out = []
    for q in quantiles:
        at = F.least(F.floor(F.col("all") * F.lit(q)), F.col("all") - 1)
        hit = (at < F.col("hi")) & (at >= F.col("hi") - F.col("n"))
        out.append(F.max(F.when(hit, F.col("x"))).alias(f"p{round(q * 100)}"))
    return places.groupBy(*keys).agg(*out)
