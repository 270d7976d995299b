"""Joins, where document stores leave them to the application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enrich(df: DataFrame, other: DataFrame, on: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """df with columns of other beside it, null where there is no match.

    on: df's column -> other's; columns: other's column -> its name in the result. Catalyst
    broadcasts other if its size is known to be small, and shuffles otherwise.
    """
    right = other.select(*[F.col(b).alias(f"on_{b}") for b in on.values()], *[F.col(c).alias(n) for c, n in columns.items()])
    same = [F.col(a) == F.col(f"on_{b}") for a, b in on.items()]
    return df.join(right, same, "left").drop(*[f"on_{b}" for b in on.values()])


def by_keys(df: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """Rows whose column is among keys, in the order of keys. The keys are in the caller's memory."""
    keys = list(dict.fromkeys(keys))
    schema = T.StructType([T.StructField("key_", df.schema[column].dataType), T.StructField("place_", T.IntegerType())])
    wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], schema)
    # a filter first: it reaches the scan
    return (
        df.where(F.col(column).isin(keys)).join(wanted, F.col(column) == F.col("key_")).orderBy("place_").drop("key_", "place_")
    )


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def nest_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, into: str, order: list[str], **totals: Column) -> DataFrame:
    """Each parent with its children as an ordered array of structs, and totals over them.

    One aggregation of the children by key, one join; a parent without children gets an
    empty array and null totals.
    """
    fields = [c for c in children.columns if c != child_key]
    rows = children.groupBy(F.col(child_key).alias("nest_key")).agg(
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias(into),
        *[c.alias(n) for n, c in totals.items()],
    )
    out = parents.join(rows, F.col(key) == F.col("nest_key"), "left").drop("nest_key")
    return out.withColumn(into, F.coalesce(into, F.array()))


def overlay(committed: DataFrame, staged: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """What a transaction sees: staged rows over committed ones, deletes taken out.

    staged has the columns of committed and the boolean column deleted, one row for a key.
    """
    kept = committed.join(staged.select(key), key, "left_anti")
    return kept.unionByName(staged.where(~F.col(deleted)).drop(deleted))
