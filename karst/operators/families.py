"""Wide columns: cells (row_key, column, ord, value, ttl, created_at, expires_at) in long form.

Rows are sparse and may have any number of columns, so the long form is what is stored; a
wide row is a map or a pivot of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import live


def put(cells: DataFrame, new: DataFrame) -> DataFrame:
    """new cells replace those of the same row and column and keep their place in the row."""
    both = cells.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in cells.columns if c not in ("row_key", "column", "ord")]
    return (
        both.groupBy("row_key", "column")
        .agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), F.struct("new_", "ord")).alias("cell"))
        .select("row_key", "column", "ord", "cell.*")
    )


def with_ttl(cells: DataFrame, seconds: int, now_ms: Column) -> DataFrame:
    """Cells as they are put with a time to live; 0 or less: none."""
    at = now_ms + F.lit(seconds * 1000) if seconds > 0 else F.lit(None)
    return cells.withColumn("ttl", (F.lit(seconds) if seconds > 0 else F.lit(None)).cast("int")).withColumn("expires_at", at.cast("bigint"))


def cleanup(cells: DataFrame, now_ms: Column) -> tuple[DataFrame, DataFrame]:
    """(the cells that haven't lapsed, one row with the numbers of cells and of whole rows removed)."""
    ok = live(F.col("expires_at"), now_ms)
    per_row = cells.groupBy("row_key").agg(F.count_if(~ok).alias("n"), F.count_if(ok).alias("left"))
    return cells.where(ok), per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("removed"), F.count_if(F.col("left") == 0).alias("rows_removed")
    )


def live_cells(cells: DataFrame, now_ms: Column) -> DataFrame:
    return cells.where(live(F.col("expires_at"), now_ms))


def row_map(cells: DataFrame, now_ms: Column) -> DataFrame:
    """(row_key, columns): the live columns of each row as a map, in the row's order."""
    entries = F.array_sort(F.collect_list(F.struct("ord", "column", "value")))
    return live_cells(cells, now_ms).groupBy("row_key").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["column"], e["value"]))).alias("columns")
    )


def wide(cells: DataFrame, columns: Sequence[str], now_ms: Column) -> DataFrame:
    """One row a key with the named columns beside each other."""
    return live_cells(cells, now_ms).groupBy("row_key").pivot("column", list(columns)).agg(F.first("value"))


def row_page(cells: DataFrame, row_key: str, limit: int, offset: int, now_ms: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value): live cells of a row in order, after offset, at most limit (0 or less: none)."""
    hit = live_cells(cells.where(F.col("row_key") == row_key), now_ms)
    if columns is not None:
        hit = hit.where(F.col("column").isin(list(columns)))
    return hit.orderBy("ord", "column").offset(max(offset, 0)).limit(max(limit, 0)).select("column", "value")


def row_slice(cells: DataFrame, start: str, end: str | None, limit: int, now_ms: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Live cells of the first limit row keys from start to end (included; None: open).

    The limit counts row keys before rows without live cells are left out.
    """
    keys = cells.where(F.col("row_key") >= start)
    keys = keys if end is None else keys.where(F.col("row_key") <= end)
    first = keys.select("row_key").distinct().orderBy("row_key").limit(max(limit, 0))
    out = live_cells(keys.join(first, "row_key", "left_semi"), now_ms)
    out = out if columns is None else out.where(F.col("column").isin(list(columns)))
    return out.select("row_key", "column", "ord", "value")


def select_columns(cells: DataFrame, row_key: str, now_ms: Column, prefix: str | None = None, pattern: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Live cells of a row by column name: a prefix, a pattern for the whole name, or names in the order asked for."""
    hit = live_cells(cells.where(F.col("row_key") == row_key), now_ms)
    if prefix is not None:
        hit = hit.where(F.col("column").startswith(prefix))
    if pattern is not None:
        hit = hit.where(F.col("column").rlike(f"^(?:{pattern})$"))
    if names is not None:
        hit = hit.where(F.col("column").isin(list(names)))
        return hit.orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("column"))).select("column", "value")
    return hit.orderBy("ord", "column").select("column", "value")


def set_ttl(cells: DataFrame, hit: Column, seconds: int, now_ms: Column) -> DataFrame:
    """Cells of hit lapse that many seconds from now; -1 takes the mark away, 0 changes nothing."""
    if seconds == 0:
        return cells.withColumn("ttl", F.when(hit, F.lit(0)).otherwise(F.col("ttl")))
    at = now_ms + F.lit(seconds * 1000) if seconds > 0 else F.lit(None)
    ttl = F.lit(seconds) if seconds > 0 else F.lit(None)
    return cells.withColumn("expires_at", F.when(hit, at).otherwise(F.col("expires_at")).cast("bigint")).withColumn(
        "ttl", F.when(hit, ttl).otherwise(F.col("ttl")).cast("int")
    )


def remaining_ttl(cells: DataFrame, now_ms: Column) -> DataFrame:
    """Adds remaining: whole seconds, -1 without a mark, 0 once lapsed."""
    left = F.floor((F.col("expires_at") - now_ms) / 1000).cast("bigint")
    return cells.withColumn(
        "remaining", F.when(F.col("expires_at").isNull(), F.lit(-1).cast("bigint")).otherwise(F.greatest(left, F.lit(0).cast("bigint")))
    )


def delete(cells: DataFrame, row_key: str, column: str | None = None) -> DataFrame:
    gone = F.col("row_key") == row_key
    return cells.where(~(gone if column is None else gone & (F.col("column") == column)))


def stats(cells: DataFrame, now_ms: Column) -> DataFrame:
    """One row: rows, columns, with_ttl, expired, and columns of a row: avg (whole number), min, max."""
    ok = live(F.col("expires_at"), now_ms)
    per_row = cells.groupBy("row_key").agg(
        F.count("*").alias("n"), F.count("expires_at").alias("t"), F.count_if(~ok).alias("e"), F.sum(F.length("value")).alias("size")
    )
    return per_row.agg(
        F.count("*").alias("rows"), F.sum("n").alias("columns"), F.sum("t").alias("with_ttl"), F.sum("e").alias("expired"),
        F.sum("size").alias("size"), F.floor(F.sum("n") / F.count("*")).cast("bigint").alias("avg_columns"),
        F.min("n").alias("min_columns"), F.max("n").alias("max_columns"),
    )


def newest_cells(cells: DataFrame, versions: int = 1) -> DataFrame:
    """The newest versions of each cell by created_at."""
    w = Window.partitionBy("row_key", "column").orderBy(F.col("created_at").desc(), F.col("ord").desc())
    return cells.withColumn("v_", F.row_number().over(w)).where(F.col("v_") <= versions).drop("v_")
