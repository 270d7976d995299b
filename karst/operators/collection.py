"""A document collection over a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import live, ttl_seconds
from ..functions.paths import source_of
from ..plans.filters import to_query
from ..plans.query import Query
from .joins import by_keys


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


class Collection:
    """Reads over a DataFrame with a unique id column.

    doc names a variant column, if the fields are in one; expires_at a column of
    epoch milliseconds, if rows can lapse. Lapsed rows are hidden everywhere.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", doc: str | None = None, expires_at: str | None = None, now: Column | None = None):
        self.raw, self.id_col, self.doc, self.expires_at = df, id_col, doc, expires_at
        self.now = now_ms() if now is None else now

    @property
    def df(self) -> DataFrame:
        """All rows that haven't lapsed."""
        return self.raw if self.expires_at is None else self.raw.where(live(F.col(self.expires_at), self.now))

    def find_all(self) -> DataFrame:
        return self.df

    def find(self, query: Query | Mapping | None = None) -> DataFrame:
        """Rows of a Query, or of a filter document."""
        query = query if isinstance(query, Query) else to_query(query)
        return query.apply(self.df, self.doc)

    def find_one(self, query: Query | Mapping | None = None) -> DataFrame:
        return self.find(query).limit(1)

    def count(self, query: Query | Mapping | None = None) -> DataFrame:
        """One row, one number; offset and limit of the query count."""
        return self.find(query).agg(F.count("*").alias("count"))

    def find_by_id(self, key) -> DataFrame:
        return self.df.where(F.col(self.id_col) == F.lit(key)).limit(1)

    def exists(self, key) -> DataFrame:
        return self.find_by_id(key).agg((F.count("*") > 0).alias("exists"))

    def find_by_ids(self, keys: Sequence) -> DataFrame:
        """Rows in the order of keys, which the caller holds in memory; absent ones are skipped."""
        return by_keys(self.df, self.id_col, keys)

    def project(self, *fields: str) -> DataFrame:
        """The id and the fields, by path."""
        source = source_of(self.df, self.doc)
        names = [f for f in dict.fromkeys(fields) if f != self.id_col]
        return self.df.select(self.id_col, *[source.value(f).key.alias(f.replace(".", "_")) for f in names])

    def ttl_stats(self) -> DataFrame:
        if self.expires_at is None:
            return self.raw.agg(F.count("*").alias("total"), F.lit(0).cast("bigint").alias("with_ttl"), F.lit(0).cast("bigint").alias("expired"))
        at = F.col(self.expires_at)
        return self.raw.agg(
            F.count("*").alias("total"), F.count(at).alias("with_ttl"), F.count_if(~live(at, self.now)).alias("expired")
        )

    def with_remaining_ttl(self) -> DataFrame:
        at = F.lit(None).cast("bigint") if self.expires_at is None else F.col(self.expires_at)
        return self.df.withColumn("ttl_seconds", ttl_seconds(at, self.now))

    # --- changes: each gives the next state as a new collection -----------------

    def _next(self, df: DataFrame) -> Collection:
        return Collection(df, self.id_col, self.doc, self.expires_at, self.now)

    def upsert(self, rows: DataFrame, order: str | None = None) -> Collection:
        """rows replace those with their ids; of rows with one id in the batch the last by order stays (without order any one)."""
        if order is None:
            last = rows.dropDuplicates([self.id_col])
        else:
            rest = [c for c in rows.columns if c != self.id_col]
            last = rows.groupBy(self.id_col).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row_")).select(self.id_col, "row_.*")
            last = last if order in self.raw.columns else last.drop(order)
        return self._next(self.raw.join(last, self.id_col, "left_anti").unionByName(last, allowMissingColumns=True))

    insert = upsert

    def update(self, rows: DataFrame) -> Collection:
        """As upsert, for ids that exist; others are ignored."""
        return self.upsert(rows.join(self.df.select(self.id_col), self.id_col, "left_semi"))

    def insert_all(self, rows: DataFrame, atomic: bool = True, order: str | None = None) -> Collection:
        """As upsert for rows with an id. With atomic, one row without an id keeps all of them out.

        What is inserted is one DataFrame, so the job that writes it commits or fails as a whole.
        """
        good = rows.where(F.col(self.id_col).isNotNull())
        if atomic:
            # one row against the batch
            bad = rows.agg((F.count_if(F.col(self.id_col).isNull()) > 0).alias("bad_"))
            good = good.join(F.broadcast(bad), ~F.col("bad_")).drop("bad_")
        return self.upsert(good, order)

    def cleanup_expired(self) -> tuple[Collection, DataFrame]:
        """(the collection without lapsed rows, one row with their number)."""
        gone = F.lit(False) if self.expires_at is None else ~live(F.col(self.expires_at), self.now)
        return self._next(self.df), self.raw.agg(F.count_if(gone).alias("removed"))

    def delete(self, query: Query | Mapping) -> Collection:
        """Without the rows of the query, its offset and limit included."""
        return self._next(self.raw.join(self.find(query).select(self.id_col), self.id_col, "left_anti"))

    def delete_by_ids(self, keys: Sequence) -> Collection:
        return self._next(self.raw.where(~F.col(self.id_col).isin(list(keys))) if keys else self.raw)

    def set_ttl(self, query: Query | Mapping, seconds: int) -> Collection:
        """Rows of the query lapse that many seconds from now; 0 or less takes the mark away."""
        at = self.expires_at or "expires_at"
        base = self.raw if self.expires_at else self.raw.withColumn(at, F.lit(None).cast("bigint"))
        hit = self.find(query).select(self.id_col).withColumn("hit_", F.lit(True))
        value = self.now + F.lit(seconds * 1000) if seconds > 0 else F.lit(None).cast("bigint")
        out = base.join(hit, self.id_col, "left").withColumn(at, F.when(F.col("hit_"), value).otherwise(F.col(at))).drop("hit_")
        return Collection(out, self.id_col, self.doc, at, self.now)

    def merge_fields(self, changes: DataFrame) -> Collection:
        """changes' non-null fields replace those of the rows with their ids (a shallow merge)."""
        named = changes.select(self.id_col, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != self.id_col])
        cols = [F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in named.columns else F.col(c) for c in self.raw.columns]
        return self._next(self.raw.join(named, self.id_col, "left").select(*cols))


def stable_page(df: DataFrame, keys: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page number (from 0) of size rows in the order of keys, with each row's place.

    Sorts once and takes a top-k; the keys should end in a unique one.
    """
    top = df.orderBy(*keys).limit((number + 1) * size)
    place = F.row_number().over(Window.orderBy(*keys))  # over the page's rows alone
    return top.withColumn("place", place).where(F.col("place") > number * size)
