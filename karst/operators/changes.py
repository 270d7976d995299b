"""Change logs: newest state, snapshots, conflicts, and tables that are merged on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyvalue import latest

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


def newest_wins(versions: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "tombstone") -> DataFrame:
    """Merge on read: the newest version of each key, unless that is a tombstone."""
    return latest(versions, key, seq, tombstone)


def snapshot(versions: DataFrame, read_ts, key: str = "key", commit_ts: str = "commit_ts", deleted: str = "deleted") -> DataFrame:
    """What a reader at read_ts sees: the newest version of each key committed by then."""
    return latest(versions.where(F.col(commit_ts) <= F.lit(read_ts)), key, commit_ts, deleted)


def conflicts(writes: DataFrame, versions: DataFrame, read_ts, key: str = "key", commit_ts: str = "commit_ts") -> DataFrame:
    """Keys of the write set that someone committed after read_ts; any means abort."""
    return writes.select(key).distinct().join(versions.where(F.col(commit_ts) > F.lit(read_ts)).select(key), key, "left_semi")


def vacuum(versions: DataFrame, oldest_read_ts, key: str = "key", commit_ts: str = "commit_ts") -> DataFrame:
    """Without versions that no reader from oldest_read_ts on can see."""
    old = F.col(commit_ts) <= F.lit(oldest_read_ts)
    head = versions.where(old).groupBy(key).agg(F.max(commit_ts).alias("head_"))
    return versions.join(head, key, "left").where(~old | (F.col(commit_ts) == F.col("head_"))).drop("head_")


def numbered_versions(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Adds version: 1, 2, ... for each key in the order of seq."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(seq)))


def version_counts(versions: DataFrame, key: str = "key") -> DataFrame:
    """One row: keys, versions, and the most versions of a key."""
    per_key = versions.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.max("n").alias("most"))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, event_type, previous_value, new_value): the changes between two states, values as JSON.

    A state may hold a key more than once: equal rows of the two states cancel one for one,
    and what is left of a key is paired in the order of its values.
    """
    rows = before.withColumn("n_", F.lit(-1)).unionByName(after.withColumn("n_", F.lit(1)))
    # dealt by key once; all that follows stays within the partitions
    rows = rows.select(key, F.struct(*sorted(before.columns)).alias("value_"), "n_").repartition(key)
    net = rows.groupBy(key, "value_").agg(F.sum("n_").alias("n_")).where("n_ <> 0")
    # values are compared as they are; only those that changed become JSON
    left = net.select(key, "value_", (F.col("n_") < 0).alias("gone_"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n_"))))
    left = left.withColumn("pair_", F.row_number().over(Window.partitionBy(key, "gone_").orderBy("value_")))
    pairs = left.groupBy(key, "pair_").agg(F.max(F.when(F.col("gone_"), F.col("value_"))).alias("v0"), F.max(F.when(~F.col("gone_"), F.col("value_"))).alias("v1"))
    kind = F.when(F.col("v0").isNull(), INSERT).when(F.col("v1").isNull(), DELETE).otherwise(UPDATE)
    return pairs.select(key, kind.alias("event_type"), F.to_json("v0").alias("previous_value"), F.to_json("v1").alias("new_value"))


def since(events: DataFrame, ts, column: str = "timestamp") -> DataFrame:
    """Events after ts."""
    return events.where(F.col(column) > F.lit(ts))


def apply_changes(state: DataFrame, changes: DataFrame, key: str, seq: str = "seq", op: str = "event_type") -> DataFrame:
    """state after a batch of changes (the columns of state, seq and event_type)."""
    last = latest(changes, key, seq)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != DELETE).select(*state.columns))


def audit(log: DataFrame, operation: str | None = None, resource: str | None = None, since_ts=None, limit: int = 100, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest entries of an audit log that pass the filters given."""
    for column, x in (("operation", operation), ("resource", resource)):
        log = log if x is None else log.where(F.col(column) == x)
    log = log if since_ts is None else log.where(F.col(ts) >= F.lit(since_ts))
    return log.orderBy(F.desc(ts), *([F.desc(tie)] if tie else [])).limit(limit)
