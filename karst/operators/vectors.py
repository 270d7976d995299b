"""Exact nearest neighbours over a column of float arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def nearest(df: DataFrame, query: list[float], k: int = 5, id_col: str = "id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(id, score) of the k nearest: cosine similarity downwards, or euclidean distance upwards.

    A projection and a top-k; zero vectors have no similarity and come last. Vectors of another length are an error.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    v = V.literal(query)
    score = V.cosine(F.col(vector), v) if metric == "cosine" else V.euclidean(F.col(vector), v)
    other = F.concat(F.lit(f"the query has {len(query)} dimensions, a vector "), F.size(vector).cast("string"))
    score = F.when(F.size(vector) != len(query), F.raise_error(other).cast("double")).otherwise(score)
    order = F.col("score").desc_nulls_last() if metric == "cosine" else F.col("score").asc_nulls_last()
    return df.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(order, "id").limit(k)


#: Queries that one pass over the table takes (more are more passes), and scores that are held at once.
QUERY_BLOCK, SCORES = 4096, 1 << 22


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row of s with their ids i, ties by id; a partition, and a sort of what is left."""
    if s.shape[1] <= k:
        return s, i
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero(s >= least[:, None])
    order = np.lexsort((i[row, col], -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k].reshape(len(s), k), col[place < k].reshape(len(s), k)
    return s[row, col], i[row, col]


def nearest_batch(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(query_id, id, score): the k nearest rows for each of queries (query_id, vector), by cosine similarity or euclidean distance.

    Query vectors go to the executors in blocks of QUERY_BLOCK; every partition compares its
    batches with them, SCORES at a time, and keeps k rows a query; a last aggregation takes the best of those.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    spark, cosine = df.sparkSession, metric == "cosine"
    n = -(-queries.count() // QUERY_BLOCK)
    out = None
    for block in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).collect()
        ids = np.array([r.query_id for r in rows], np.int64)
        q = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)
        if cosine:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s, best_i = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            step = max(1, SCORES // max(1, len(ids)))
            for b in batches:
                if not b.num_rows:
                    continue
                at = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                for a in range(0, b.num_rows, step):
                    y = x[a : a + step]
                    if cosine:
                        norm = np.linalg.norm(y, axis=1)
                        s = np.where(norm > 0, q @ (y / np.maximum(norm, 1e-300)[:, None]).T, -np.inf)
                    else:
                        s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (y**2).sum(1) - 2 * q @ y.T, 0))
                    i = np.broadcast_to(at[a : a + step], s.shape)
                    best_s, best_i = _best(np.hstack([best_s, s]), np.hstack([best_i, i]), k)
            keep = best_s.ravel() > -np.inf
            yield pa.RecordBatch.from_pydict(
                {"query_id": np.repeat(ids, best_s.shape[1])[keep], "id": best_i.ravel()[keep], "score": best_s.ravel()[keep]}
            )

        part = df.select(F.col(id_col).cast("bigint"), vector).where(F.col(vector).isNotNull())
        part = part.mapInArrow(run, "query_id bigint, id bigint, score double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double")
    # k rows a query and partition at most
    tops = out.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "id"))), 1, k).alias("top")
    )
    score = -F.col("t.d") if cosine else F.col("t.d")
    return tops.select("query_id", F.explode("top").alias("t")).select("query_id", "t.id", score.alias("score"))


class VectorIndex:
    """A table (id, embedding) of vectors of dims numbers, searched exactly."""

    def __init__(self, df: DataFrame, dims: int, id_col: str = "id", vector: str = "embedding"):
        if dims <= 0:
            raise ValueError("dims must be above 0")
        self.df, self.dims, self.id_col, self.vector = df, dims, id_col, vector

    def _next(self, df: DataFrame) -> VectorIndex:
        return VectorIndex(df, self.dims, self.id_col, self.vector)

    def add(self, rows: DataFrame) -> VectorIndex:
        """rows replace those with their ids; vectors of another length are an error."""
        wrong = F.raise_error(F.lit(f"vectors have {self.dims} dimensions")).cast(rows.schema[self.vector].dataType)
        checked = rows.select(self.id_col, F.when(F.size(self.vector) == self.dims, F.col(self.vector)).otherwise(wrong).alias(self.vector))
        kept = self.remove(rows.select(self.id_col)).df
        return self._next(kept.select(self.id_col, self.vector).unionByName(checked))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return self._next(self.df.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"))

    def stats(self) -> DataFrame:
        """One row: size, dims and zero vectors, which no cosine search finds."""
        zero = ~F.exists(self.vector, lambda x: x != 0)
        return self.df.agg(F.count("*").alias("size"), F.lit(self.dims).alias("dims"), F.count_if(zero).alias("zero_vectors"))

    def search(self, query: list[float], k: int = 5, accuracy: float = 1.0, metric: str = "cosine") -> DataFrame:
        """(id, score) of the k nearest. The search is exact, so it meets any accuracy (0 to 1) asked for."""
        self._check(accuracy)
        if len(query) != self.dims:
            raise ValueError(f"the query has {len(query)} dimensions, the index {self.dims}")
        return nearest(self.df, query, k, self.id_col, self.vector, metric)

    def search_batch(self, queries: DataFrame, k: int = 5, accuracy: float = 1.0, metric: str = "cosine") -> DataFrame:
        self._check(accuracy)
        return nearest_batch(self.df, queries, k, self.id_col, self.vector, metric)

    @staticmethod
    def _check(accuracy: float) -> None:
        if not 0 < accuracy <= 1:
            raise ValueError("accuracy must be above 0 and at most 1")

    def save(self, path: str) -> None:
        self.df.select(self.id_col, self.vector).write.mode("overwrite").parquet(path)

    def load(self, path: str) -> VectorIndex:
        return self._next(self.df.sparkSession.read.parquet(path))
