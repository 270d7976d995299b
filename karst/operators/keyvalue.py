"""Key-value buckets: the state of a key is what its ordered log of changes leads to.

Logs are DataFrames (key, value, seq, ...); state is computed for all keys at once by
aggregates that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import live
from .joins import by_keys


def latest(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is a deletion are left out."""
    rest = [c for c in log.columns if c != key]
    out = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row")).select(key, "row.*")
    return out if deleted is None else out.where(~F.col(deleted)).drop(deleted)


def get_live(state: DataFrame, now_ms: Column, expires_at: str = "expires_at") -> DataFrame:
    """Keys that haven't lapsed."""
    return state.where(live(F.col(expires_at), now_ms))


def counters(log: DataFrame, key: str = "key", delta: str = "delta") -> DataFrame:
    """(key, value): every key starts at 0; increments and decrements are deltas."""
    return log.groupBy(key).agg(F.sum(F.col(delta)).cast("bigint").alias("value"))


def get_all(state: DataFrame, keys: Sequence[str], key: str = "key") -> DataFrame:
    """Those of the keys that exist, in the order asked for."""
    return by_keys(state, key, keys)


def by_prefix(state: DataFrame, prefix: str, now_ms: Column, key: str = "key", expires_at: str = "expires_at") -> DataFrame:
    """(key, has_ttl, expires_at, expired), sorted by key."""
    at = F.col(expires_at)
    return (
        state.where(F.col(key).startswith(prefix))
        .select(key, at.isNotNull().alias("has_ttl"), at.alias("expires_at"), (~live(at, now_ms)).alias("expired"))
        .orderBy(key)
    )


def bucket_stats(state: DataFrame, now_ms: Column, elements: Column | None = None, expires_at: str = "expires_at") -> DataFrame:
    """total, expired, active; with elements (the size of each entry) their sum as well."""
    ok = live(F.col(expires_at), now_ms)
    out = [F.count("*").alias("total"), F.count_if(~ok).alias("expired"), F.count_if(ok).alias("active")]
    if elements is not None:
        out.append(F.coalesce(F.sum(elements), F.lit(0)).cast("bigint").alias("elements"))
    return state.agg(*out)


def fold_lists(log: DataFrame, key: str = "key", op: str = "op", value: str = "value", seq: str = "seq") -> DataFrame:
    """(key, items) after the pushes and pops ("lpush", "rpush", "lpop", "rpop") of each key in order.

    A key's log is folded as an array, so it must fit in a task's memory.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(op).alias("op"), F.col(value).alias("value"))))
    start = F.array().cast("array<string>")

    def step(items: Column, s: Column) -> Column:
        n = F.size(items)
        return (
            F.when(s["op"] == "lpush", F.concat(F.array(s["value"]), items))
            .when(s["op"] == "rpush", F.concat(items, F.array(s["value"])))
            .when(s["op"] == "lpop", F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0))))
            .when(s["op"] == "rpop", F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))))
            .otherwise(items)
        )

    return log.groupBy(key).agg(F.aggregate(steps, start, step).alias("items"))


def fold_hashes(log: DataFrame, key: str = "key", field: str = "field", value: str = "value", seq: str = "seq") -> DataFrame:
    """(key, fields): the newest value of each field; a null value deletes the field."""
    newest = log.groupBy(key, field).agg(F.max_by(value, seq).alias("v")).where("v is not null")
    return newest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "v")))).alias("fields"))


def members(log: DataFrame, key: str = "key", member: str = "member", seq: str = "seq", removed: str = "removed") -> DataFrame:
    """(key, member) of the sets after adds and removals; one row a member, so no set has to fit in memory."""
    newest = log.groupBy(key, member).agg(F.max_by(removed, seq).alias("gone"))
    return newest.where(~F.col("gone")).select(key, member)


def move_member(rows: DataFrame, source: str, target: str, value, key: str = "key", member: str = "member") -> DataFrame:
    """(key, member) after value went from the source set to the target, if it was there."""
    hit = (F.col(key) == source) & (F.col(member) == F.lit(value))
    return rows.select(F.when(hit, F.lit(target)).otherwise(F.col(key)).alias(key), member).distinct()


def move_last(state: DataFrame, source: str, target: str, key: str = "key", items: str = "items") -> DataFrame:
    """(key, items) after the last element of the source list went to the front of the target, which is made if there is none."""
    moved = state.where((F.col(key) == source) & (F.size(items) > 0)).select(F.lit(target).alias("to_"), F.element_at(items, -1).alias("moved_"))
    # one row at most on the right
    both = state.join(F.broadcast(moved.select(F.lit(source).alias("from_"))), F.col(key) == F.col("from_"), "left")
    left = F.when(F.col("from_").isNotNull(), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(F.col(items))
    both = both.select(key, left.alias(items)).join(moved, F.col(key) == F.col("to_"), "full")
    none = F.array().cast(state.schema[items].dataType)
    return both.select(
        F.coalesce(key, "to_").alias(key),
        F.when(F.col("to_").isNull(), F.col(items)).otherwise(F.concat(F.array("moved_"), F.coalesce(items, none))).alias(items),
    )


def without(state: DataFrame, keys: Sequence[str], key: str = "key") -> DataFrame:
    """The state once the keys are deleted; no keys given: cleared."""
    return state.where(~F.col(key).isin(list(keys))) if keys else state.limit(0)


def expire(state: DataFrame, key_value: str, seconds: int, now_ms: Column, key: str = "key", expires_at: str = "expires_at") -> DataFrame:
    """The key lapses that many seconds from now."""
    at = F.when(F.col(key) == key_value, now_ms + F.lit(seconds * 1000)).otherwise(F.col(expires_at))
    return state.withColumn(expires_at, at.cast("bigint"))


def set_inter(rows: DataFrame, keys: Sequence[str], key: str = "key", member: str = "member") -> DataFrame:
    """Members of all the sets; an unknown key is an empty set."""
    n = len(set(keys))
    hit = rows.where(F.col(key).isin(list(keys))).select(key, member).distinct()
    return hit.groupBy(member).agg(F.count("*").alias("n")).where(F.col("n") == n).select(member) if n else hit.limit(0).select(member)


def set_union(rows: DataFrame, keys: Sequence[str], key: str = "key", member: str = "member") -> DataFrame:
    return rows.where(F.col(key).isin(list(keys))).select(member).distinct()


def set_diff(rows: DataFrame, first: str, rest: Sequence[str], key: str = "key", member: str = "member") -> DataFrame:
    """Members of first that none of the others has."""
    hit = rows.where(F.col(key).isin([first, *rest])).groupBy(member)
    other = F.max(F.col(key).isin(list(rest))) if rest else F.lit(False)
    return hit.agg(F.max(F.col(key) == first).alias("a"), other.alias("b")).where("a and not b").select(member)
