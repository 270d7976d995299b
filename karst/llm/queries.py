"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    cgk_decontaminate,
    chat_format,
    crf_quality,
    line_dedup,
    mixing,
    risk_rules,
    secret_forest,
    simhash_gray,
    toxicity,
    url_filter,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


#: A conversation whose texts are control strings, formatted along with the table's.
_CONTROL_CONVERSATION = """
SELECT * FROM VALUES
  (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
AS t(conv_id, turn, role, text)
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.format_turns(rows.unionByName(spark.sql(_CONTROL_CONVERSATION))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _chat_sql() -> str:
    """What reading back must give: digests of the table's own texts, and the escaped lengths."""
    control = "|".join(re.escape(c) for c in (*chat_format.CONTROL, "\\")).replace("'", "''")
    marks = len(chat_format.TURN + chat_format.TEXT + chat_format.END)

    def shown(x: str) -> str:
        return f"length({x}) + len(regexp_extract_all({x}, '{control}'))"

    order = "ORDER BY turn NULLS FIRST, role, text"
    loss = f"coalesce(string_agg(text, '' {order}) FILTER (role = '{chat_format.LOSS_ROLE}'), '')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       length({loss}) AS loss_chars, sha256({loss}) AS loss_sha256,
       CAST(sum({marks} + {shown("role")} + {shown("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_rules": op6_rules,
    "op7_urls": op7_urls,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op9_chat": _chat_sql(),
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM d, unnest(generate_series(1, len(ls))) AS u(i)),
t AS (SELECT doc_id, i, list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM l),
v AS (SELECT doc_id, i, w, row_number() OVER (ORDER BY doc_id, i) AS r, len(w) AS n FROM t WHERE len(w) > 0),
e AS (SELECT r, n, unnest(w) AS tok FROM v),
f AS (SELECT tok, count(*) AS c FROM e GROUP BY tok),
o AS (SELECT r, n, e.tok, row_number() OVER (PARTITION BY r ORDER BY c, e.tok) AS k FROM e JOIN f ON e.tok = f.tok),
p AS (SELECT r, n, tok FROM o WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT x.r AS a, y.r AS b FROM p x JOIN p y ON x.tok = y.tok AND y.r < x.r AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n),
g AS (SELECT DISTINCT a FROM c JOIN v x ON x.r = a JOIN v y ON y.r = b
      WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
k AS (SELECT l.doc_id, l.i, l.line, g.a IS NOT NULL AS gone
      FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND v.i = l.i LEFT JOIN g ON g.a = v.r)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id
""",
}
