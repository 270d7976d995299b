"""Text search: scored scans, and an inverted index as a table of postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Hash values of ids. The list of those that several rows have is no longer than this, so it is broadcast by hand.
BUCKETS = 1 << 16


def scored(df: DataFrame, query: str, field: str = "text") -> DataFrame:
    """df with a score beside each row that has the field."""
    # a generator, so that the words are split once and not at each use
    parts = df.where(F.col(field).isNotNull()).select("*", F.explode(F.array(X.score_parts(F.col(field)))).alias("score_parts_"))
    return parts.withColumn("score", X.score_of(F.col("score_parts_"), query)).drop("score_parts_")


def search(df: DataFrame, query: str, field: str = "text", min_score: float = 0.1, max_results: int = 10, tie: str | None = None) -> DataFrame:
    """Rows of at least min_score, best first; one pass and a top-k."""
    hits = scored(df, query, field).where(F.col("score") >= min_score)
    return hits.orderBy(F.desc("score"), *([tie] if tie else [])).limit(max_results)


def postings(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(token, id, pos): pos counts the tokens that are left after stop words."""
    return df.select(F.posexplode(X.tokens(F.col(field))).alias("pos", "token"), F.col(id_col).alias("id")).select("token", "id", "pos")


def add(index: DataFrame, df: DataFrame, id_col: str, field: str) -> DataFrame:
    """The postings with those of df's documents in place of earlier ones."""
    return remove(index, df.select(F.col(id_col).alias("id"))).unionByName(postings(df, id_col, field))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings or entries without those of the documents ids (id)."""
    return index.join(ids.select("id").distinct(), "id", "left_anti").select(*index.columns)


def entries(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(id, tokens, shared): the different tokens of each row, and whether other rows may have its id.

    Where no other row has it, pairs of token and document need no comparison. ``shared`` errs
    on the safe side: it holds for all ids that meet a repeated one in a bucket.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket_")
    repeated = df.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select(bucket).distinct().withColumn("repeated_", F.lit(True))
    rows = df.select(F.col(id_col).alias("id"), F.col(field).alias("text_")).select("id", "text_", bucket)
    rows = rows.join(F.broadcast(repeated), "bucket_", "left")
    return rows.select("id", X.token_set(F.col("text_")).alias("tokens"), F.col("repeated_").isNotNull().alias("shared"))


def add_entries(df: DataFrame, new: DataFrame, id_col: str, field: str) -> DataFrame:
    """entries of df with new's documents in place of those with their ids.

    Documents are replaced before they are split: texts take less room in a shuffle than tokens.
    """
    old = df.join(new.select(id_col).distinct(), id_col, "left_anti")
    return entries(old, id_col, field).unionByName(entries(new, id_col, field))


def _known(index: DataFrame, words: Sequence[str]) -> DataFrame:
    return index.where(F.col("token").isin(list(words)))


def _query_tokens(index: DataFrame, query: str) -> list[str]:
    row = index.sparkSession.range(1).select(X.tokens(F.lit(query)).alias("t")).first()
    return list(dict.fromkeys(row.t))


def search_all(index: DataFrame, query: str) -> DataFrame:
    """(id) of the documents with all of the query's tokens; tokens that no document has don't count."""
    words = _query_tokens(index, query)
    hit = _known(index, words)
    known = hit.agg(F.count_distinct("token").alias("known"))
    per_id = hit.groupBy("id").agg(F.count_distinct("token").alias("n"))
    # one row against the counts
    return per_id.join(F.broadcast(known), F.col("n") == F.col("known")).select("id")


def phrase_in(df: DataFrame, id_col: str, field: str, phrases: Sequence[str | None]) -> DataFrame:
    """(id) of the documents with any of the phrases, stop words transparent; no shuffle."""
    found = [p for p in phrases if p is not None]
    hit = F.lit(False)
    for p in found:
        hit = hit | X.has_phrase(F.col("tokens_"), _phrase_tokens(df, p))
    # a generator, so that the tokens aren't computed anew at each use
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(X.tokens(F.col(field)))).alias("tokens_"))
    return rows.where(hit).select("id")


def _phrase_tokens(df: DataFrame, phrase: str) -> list[str]:
    return df.sparkSession.range(1).select(X.tokens(F.lit(phrase)).alias("t")).first().t


def phrase_postings(index: DataFrame, phrase: str) -> DataFrame:
    """(id) as phrase_in, from postings: tokens of one start are counted, not joined k times."""
    words = _phrase_tokens(index, phrase)
    spark = index.sparkSession
    if not words:
        return index.select("id").limit(0)
    wanted = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, i int")
    at = index.join(F.broadcast(wanted), "token").select("id", (F.col("pos") - F.col("i")).alias("start"), "i").distinct()
    return at.groupBy("id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("id").distinct()


def vocabulary(index: DataFrame) -> DataFrame:
    """(token, documents)"""
    return index.groupBy("token").agg(F.count_distinct("id").alias("documents"))


def vocabulary_of(rows: DataFrame) -> DataFrame:
    """vocabulary of entries: counts combine before the shuffle; only shared ids are compared."""
    # outer, since explode makes the optimizer test for tokens beforehand and so compute them twice
    at = rows.select("id", "shared", F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())
    at = at.select("token", F.when(~F.col("shared"), F.col("id")).alias("own"), F.when(F.col("shared"), F.col("id")).alias("common"))
    return at.groupBy("token").agg((F.count("own") + F.count_distinct("common")).alias("documents"))


def index_size(index: DataFrame) -> DataFrame:
    """One row: pairs of token and document."""
    return index.select("token", "id").distinct().agg(F.count("*").alias("size"))


def index_size_of(rows: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """index_size of entries, without those of the documents removed (id).

    Tokens are counted before the join, so that it moves ids and counts; only shared ids keep theirs.
    """
    own = F.when(~F.col("shared"), F.size("tokens"))
    rows = rows.select("id", own.alias("own"), F.when(F.col("shared"), F.col("tokens")).alias("common"))
    if removed is not None:
        # not an anti join: the optimizer moves that below the counting, and whole texts are shuffled
        gone = removed.select("id").distinct().withColumn("gone_", F.lit(True))
        rows = rows.join(gone, "id", "left").where(F.col("gone_").isNull())
    at = rows.select("own", "id", F.explode_outer("common").alias("token"))
    pair = F.when(F.col("token").isNotNull(), F.struct("token", "id"))
    return at.agg((F.coalesce(F.sum("own"), F.lit(0)) + F.count_distinct(pair)).alias("size"))
