"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder of that name below spark.checkpoint.dir.

    Only where the session names none and the master is local is a temporary folder made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="karst-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/karst-{name}-{uuid.uuid4().hex}"
