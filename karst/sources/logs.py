"""Write-ahead logs, change-event files and sorted runs of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Change events as stored.
EVENTS = (
    "event_id string, event_type string, collection string, key string, previous_value string, new_value string, "
    "timestamp bigint, metadata map<string,string>"
)


def parse_wal(lines: DataFrame, line: str = "value") -> DataFrame:
    """(seq, ts, kind, collection, key, value) of ``seq|ts|KIND|collection|key|value``; other lines are left out.

    The value may hold more bars.
    """
    p = F.split(line, r"\|", 6)
    rows = lines.where(F.size(p) >= 5).select(
        F.get(p, 0).try_cast("bigint").alias("seq"), F.get(p, 1).try_cast("bigint").alias("ts"), F.get(p, 2).alias("kind"),
        F.get(p, 3).alias("collection"), F.get(p, 4).alias("key"), F.get(p, 5).alias("value"),
    )
    return rows.where("seq is not null")


def recoverable(wal: DataFrame) -> DataFrame:
    """Entries after the last checkpoint."""
    last = wal.where("kind = 'CHECKPOINT'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return wal.join(F.broadcast(last), F.col("seq") > F.col("last")).drop("last")


def replay(wal: DataFrame) -> DataFrame:
    """(collection, key, value): the state after the entries."""
    newest = wal.groupBy("collection", "key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("e"))
    return newest.where("e.kind <> 'DELETE'").select("collection", "key", F.col("e.value").alias("value"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def write_events(events: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append change events as JSON lines, in files of at most so many rows."""
    events.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Send change events to Kafka, keyed by collection. Needs Spark's Kafka package."""
    rows = events.select(F.col("collection").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").save()


def compact(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Write a table sorted by key, so that row-group statistics prune lookups and ranges by key."""
    by = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    by.sortWithinPartitions(key).write.mode("overwrite").option("parquet.bloom.filter.enabled#" + key, "true").parquet(path)
