"""JSON documents: reading, bulk loading, backup and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row a document: its id, its fields as a variant, and when it lapses (epoch milliseconds).
SCHEMA = "id string, doc variant, expires_at bigint"


def parse(json: Column) -> Column:
    """A struct of SCHEMA from a JSON object: ``{id, fields: {...}, expiresAt}`` or flat, the id among the fields.

    Null if it isn't an object.
    """
    v = F.try_parse_json(json)
    at = lambda path, t: F.try_variant_get(v, path, t)
    nested = F.schema_of_variant(at("$.fields", "variant")).startswith("OBJECT")
    ok = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(
        ok,
        F.struct(
            at("$.id", "string").alias("id"),
            F.when(nested, at("$.fields", "variant")).otherwise(v).alias("doc"),
            at("$.expiresAt", "bigint").alias("expires_at"),
        ),
    )


def read_or_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt lines as value): what isn't a JSON object is set aside, not lost."""
    rows = spark.read.text(path).select("value", parse(F.col("value")).alias("d"))
    good = rows.where("d is not null").select("d.*").withColumn("id", F.coalesce("id", F.uuid()))
    return good, rows.where("d is null and trim(value) <> ''").select("value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file with one JSON object a line; documents without an id get a UUID."""
    rows = spark.read.text(path).select(parse(F.col("value")).alias("d")).where("d is not null").select("d.*")
    return rows.withColumn("id", F.coalesce("id", F.uuid()))


def bulk(rows: DataFrame, json: str = "value") -> tuple[DataFrame, DataFrame]:
    """(documents, one row with the numbers inserted and skipped) of a column with an array of objects."""
    parts = rows.select(F.explode(_elements(F.col(json))).alias("e"))
    parsed = parts.select(parse(F.col("e")).alias("d"))
    counts = parsed.agg(F.count("d").alias("inserted"), F.count_if(F.col("d").isNull()).alias("skipped"))
    return parsed.where("d is not null").select("d.*"), counts


def _elements(json: Column) -> Column:
    """The elements of a JSON array, each as JSON text."""
    return F.transform(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), lambda v: F.to_json(v))


def backup(collections: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all collections as gzipped JSON, a folder each; gives (collection, documents) as written.

    Each is one job that commits as a whole.
    """
    if not collections:
        raise ValueError("there is nothing to back up")
    for name, df in collections.items():
        df.withColumn("collection", F.lit(name)).write.partitionBy("collection").mode("append").json(path, compression="gzip")
    spark = next(iter(collections.values())).sparkSession
    return spark.read.json(path).groupBy("collection").agg(F.count("*").alias("documents"))


def restore(spark: SparkSession, path: str, collection: str, schema) -> DataFrame:
    """The rows of a collection from a backup; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/collection={collection}")
