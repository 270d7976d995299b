"""Change feeds: file streams of events, latest state, windows and expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import DELETE, apply_changes


def read_feed(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, kind: str = "parquet") -> DataFrame:
    """A stream of the files that appear in path."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def event_time(df: DataFrame, column: str, late: str) -> DataFrame:
    """column as a time zone aware timestamp with a watermark; zoneless ones can't carry one."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates of each window and key; without slide the windows don't overlap."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = event_time(df, ts, late).groupBy(w.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour", **aggregates) -> DataFrame:
    """Aggregates of each run of events with no longer pause than gap."""
    out = event_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("session"), *keys)
    out = out.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *keys, *aggregates)


def once_each(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than that is dropped."""
    return event_time(df, ts, late).dropDuplicatesWithinWatermark(keys)


def latest_state(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest row of each key, as a streaming aggregation (complete or update mode)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row")).select(key, "row.*")


def write_events(df: DataFrame, path: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Append a stream to files, exactly once, and stop when the input is read."""
    return df.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_to_files(df: DataFrame, mode: str, base: str) -> DataFrame:
    """Run a stream to the end of its input and read its result: all batches in append mode, the last one in complete mode.

    A batch is a folder of its own, so one that runs again replaces itself.
    """
    spark, out = df.sparkSession, f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = _numbers(spark, out, "batch")
    if not batches:
        return spark.createDataFrame([], df.schema)
    wanted = batches if mode == "append" else [max(batches)]
    return spark.read.schema(df.schema).parquet(*[f"{out}/batch={n}" for n in wanted])


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders name=0, name=1, ... in path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))


def read_materialized(spark: SparkSession, path: str) -> DataFrame:
    """The newest state that materialize wrote to path."""
    return spark.read.parquet(f"{path}/version={max(_numbers(spark, path, 'version'))}")


def expirations(df: DataFrame, ts: str, ttl: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, expired_at) once a key had no write for ttl; each write renews it.

    A session whose gap is the time to live ends when its last write lapses, so Spark's own state and watermark serve as timers.
    """
    return sessions(df, ts, ttl, keys, late, writes=F.count("*")).select(*keys, F.col("end").alias("expired_at"), "writes")


def materialize(changes: DataFrame, path: str, checkpoint: str, key: str, seq: str = "seq", op: str = "event_type") -> StreamingQuery:
    """Keep a table of the newest state of each key in path, a version for each batch.

    A batch is written beside the version before, so a failed one leaves that untouched;
    the highest version is the state. Re-running a batch gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c not in (op,)]
        before = spark.createDataFrame([], batch.select(*columns).schema)
        if number > 0:
            before = spark.read.schema(before.schema).parquet(f"{path}/version={number - 1}")
        apply_changes(before, batch, key, seq, op).write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(changes: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call handler with each batch of changes."""
    return changes.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_changes(df: DataFrame, key: str, seq: str, collection: str) -> DataFrame:
    """Rows as change events: the first row of a key is an insert only in the log's own sense, so all are upserts."""
    return df.select(
        F.concat_ws("-", F.lit(collection), F.col(key).cast("string"), F.col(seq).cast("string")).alias("event_id"),
        F.lit("UPDATE").alias("event_type"), F.lit(collection).alias("collection"), F.col(key).cast("string").alias("key"),
        F.lit(None).cast("string").alias("previous_value"), F.to_json(F.struct(*df.columns)).alias("new_value"),
        F.col(seq).cast("bigint").alias("timestamp"),
    )


__all__ = [
    "DELETE", "as_changes", "event_time", "expirations", "latest_state", "materialize", "once_each", "read_feed", "read_materialized", "run_to_files",
    "sessions", "subscribe", "tumbling", "write_events",
]
