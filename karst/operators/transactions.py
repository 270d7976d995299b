"""Transactions over a log of versions (key, value columns, commit_ts, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import conflicts, snapshot
from .joins import overlay


class ConflictError(RuntimeError):
    """Someone else committed a key of the write set after the transaction began."""


class Transaction:
    """Reads see the snapshot at read_ts under the transaction's own writes; commit adds all of these or none."""

    def __init__(self, versions: DataFrame, read_ts, key: str = "key", commit_ts: str = "commit_ts", deleted: str = "deleted"):
        self.versions, self.read_ts, self.key, self.commit_ts, self.deleted = versions, read_ts, key, commit_ts, deleted
        self.staged: DataFrame | None = None

    def _stage(self, rows: DataFrame) -> Transaction:
        if self.staged is not None:
            rows = self.staged.join(rows.select(self.key).distinct(), self.key, "left_anti").unionByName(rows)
        self.staged = rows
        return self

    def put(self, rows: DataFrame) -> Transaction:
        """Stage rows (the columns of the log but commit_ts and deleted), one for each key."""
        return self._stage(rows.withColumn(self.deleted, F.lit(False)))

    def delete(self, keys: DataFrame) -> Transaction:
        """Stage the deletion of keys."""
        rest = [f for f in self.versions.schema if f.name not in (self.key, self.commit_ts, self.deleted)]
        rows = keys.select(self.key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest]).distinct()
        return self._stage(rows.withColumn(self.deleted, F.lit(True)))

    def read(self) -> DataFrame:
        base = snapshot(self.versions, self.read_ts, self.key, self.commit_ts, self.deleted).drop(self.commit_ts)
        return base if self.staged is None else overlay(base, self.staged.select(*base.columns, self.deleted), self.key)

    def rollback(self) -> DataFrame:
        """Drop what was staged; the log stays as it was."""
        self.staged = None
        return self.versions

    def commit(self, commit_ts) -> DataFrame:
        """The log with the staged versions at commit_ts; raises if a key has a newer version."""
        if self.staged is None:
            return self.versions
        if not conflicts(self.staged, self.versions, self.read_ts, self.key, self.commit_ts).isEmpty():
            raise ConflictError(f"a key was committed after {self.read_ts}")
        kind = self.versions.schema[self.commit_ts].dataType
        return self.versions.unionByName(self.staged.withColumn(self.commit_ts, F.lit(commit_ts).cast(kind)))
