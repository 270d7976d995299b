"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MAX_LONG = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none (plain local tests) is a temporary folder
    made; a local master has no other machine that would have to see it.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="karst-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared folder that cut the lineage of a job of several steps.

    A lost executor costs a re-read or the step at hand, never the steps before. The
    shuffle files of a step are deleted once its table is written, and so is a table
    that ``drop`` names.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/karst-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.where: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.n += 1
        path, schema, before = f"{self.path}/{self.n}", df.schema, self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        self.where[id(out)] = path
        self.kept.append(out)  # so that no other frame gets its id
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still to be computed reads."""
        for t in tables:
            self._delete(self.where.pop(id(t)))

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete every table but these."""
        kept = {id(t) for t in tables}
        for k in [k for k in self.where if k not in kept]:
            self._delete(self.where.pop(k))

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, in any letter case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, n: int) -> Column:
    """crc32 of the id's text modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) with one row for each labelled document.

    Null ids and null labels are left out; where rows disagree the larger label holds.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(target).cast("int")).alias("label"))
    )


def bounded_sample(rows: DataFrame, per_class: dict[int, int]) -> DataFrame:
    """At most per_class[k] rows of label k, the ones whose hashed id comes first.

    The choice depends on ids only, so reruns agree; its size has a fixed bound.
    """
    parts = [
        rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in per_class.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
