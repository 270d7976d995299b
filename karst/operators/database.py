"""A registry of named collections over one Spark session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collection import Collection
from .pipeline import Pipeline


class Database:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self._made: dict[str, Collection] = {}

    def register(self, name: str, df: DataFrame, **options) -> Collection:
        df.createOrReplaceTempView(name)
        self._made[name] = Collection(df, **options)
        return self._made[name]

    def collection(self, name: str, **options) -> Collection:
        """A registered collection, or the Parquet table of that name below root."""
        if name not in self._made:
            if self.root is None:
                raise KeyError(name)
            self.register(name, self.spark.read.parquet(f"{self.root}/{name}.parquet"), **options)
        return self._made[name]

    def ensure(self, name: str, schema: T.StructType | str, **options) -> Collection:
        """The collection, made empty if there is none."""
        return self._made.get(name) or self.register(name, self.spark.createDataFrame([], schema), **options)

    def entities(self, name: str) -> Collection:
        """The collection for reading; an unknown one is empty and isn't made."""
        return self._made.get(name) or Collection(self.spark.createDataFrame([], "id string"))

    def drop(self, name: str) -> bool:
        """Forget a collection; False if there is none."""
        if name in self._made:
            self.spark.catalog.dropTempView(name)
        return self._made.pop(name, None) is not None

    def catalog(self) -> DataFrame:
        """(name, documents) of the registered collections, lapsed rows left out."""
        out = self.spark.createDataFrame([], "name string, documents bigint")
        for name, c in sorted(self._made.items()):
            out = out.unionAll(c.df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("name"), "documents"))
        return out

    def names(self) -> list[str]:
        return sorted(self._made)

    def pipeline(self, name: str) -> Pipeline:
        c = self.collection(name)
        return Pipeline(c.df, c.id_col, c.doc)

    def sql(self, text: str) -> DataFrame:
        """SQL over the registered collections."""
        return self.spark.sql(text)

    def stats(self) -> Mapping[str, DataFrame]:
        return {n: c.ttl_stats() for n, c in self._made.items()}

    @staticmethod
    def explain(df: DataFrame) -> dict[str, object]:
        """What the optimizer makes of df: the plan's text, its scans' pushed filters, its exchanges."""
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        lines = [x.strip() for x in plan.splitlines()]
        return {
            "plan": plan,
            "pushed_filters": [x.partition(": ")[2] for x in lines if x.startswith("PushedFilters")],
            "read_schemas": [x.partition(": ")[2] for x in lines if x.startswith("ReadSchema")],
            "exchanges": sum(") Exchange" in x for x in lines),
        }
