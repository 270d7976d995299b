"""The registered queries of the engine, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formula as FX
from .functions import lists as L
from .functions import maps as M
from .functions import predicates as P
from .functions import sets as S
from .functions import text as X
from .functions.paths import source_of
from .operators import aggregates as A
from .operators import changes as C
from .operators import families as W
from .operators import joins as J
from .operators import keyvalue as K
from .operators import schema as SC
from .operators import textindex as TI
from .operators import vectors as V
from .operators.collection import Collection
from .operators.pipeline import Pipeline
from .plans import dsl, filters
from .plans import query as Q
from .plans.query import Query, SortKey
from .sources import documents as D
from .sources import logs as LG
from .sources.shared import shared_dir
from .streaming import feed

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}
#: "Now" of the queries that deal with expiry: 2024-01-16 00:00 UTC in epoch milliseconds.
NOW = 1_705_363_200_000


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events_doc(spark: SparkSession, d: str) -> DataFrame:
    """Events as variant documents; odd users' documents lack k, those of users divisible by 10 hold a null."""
    e = t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    doc = (
        F.when(F.col("user_id") % 2 == 1, F.lit('{"a": 1}'))
        .when(F.col("user_id") % 10 == 0, F.lit('{"k": null}'))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "n": {"t": ["'), F.col("event_type"), F.lit('"]}}')))
    )
    return e.select("event_id", F.parse_json(doc).alias("doc"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_HAS = "(user_id % 2 = 0 AND user_id % 10 <> 0)"


# --- predicates ---------------------------------------------------------------

_CUSTOMER = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _predicate(name: str, table: str, columns: tuple[str, ...], q: Query, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return q.apply(t(spark, d, table)).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(run)


_predicate("doc_eq", "customer", _CUSTOMER, Q.eq("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'")
_predicate("doc_ne", "customer", _CUSTOMER, Q.ne("c_mktsegment", "BUILDING"), "c_mktsegment <> 'BUILDING'")
_predicate("doc_gt", "customer", _CUSTOMER, Q.gt("c_acctbal", 5000), "c_acctbal > 5000")
_predicate("doc_gte", "part", ("p_partkey", "p_size"), Q.gte("p_size", 40), "p_size >= 40")
_predicate("doc_lt", "customer", _CUSTOMER, Q.lt("c_acctbal", 0), "c_acctbal < 0")
_predicate("doc_lte", "part", ("p_partkey", "p_size"), Q.lte("p_size", 5), "p_size <= 5")
_predicate("doc_between", "orders", ("o_orderkey", "o_totalprice"), Q.between("o_totalprice", 1000, 90000), "o_totalprice BETWEEN 1000 AND 90000")
_predicate("doc_in", "orders", ("o_orderkey", "o_orderstatus"), Q.is_in("o_orderstatus", ["F", "P"]), "o_orderstatus IN ('F', 'P')")
_predicate("doc_in_strict", "part", ("p_partkey", "p_size"), Q.is_in("p_size", [1, 2.0, "3"]), "p_size = 1")
_predicate("doc_contains", "part", ("p_partkey", "p_name"), Q.contains("p_name", "1"), "contains(p_name, '1')")
_predicate("doc_contains_number", "part", ("p_partkey", "p_size"), Q.contains("p_size", "4"), "contains(CAST(p_size AS VARCHAR), '4')")
_predicate("doc_regex", "part", ("p_partkey", "p_brand"), Q.regex("p_brand", "#[12][0-9]?$"), "regexp_matches(p_brand, '#[12][0-9]?$')")
_predicate("doc_exists", "orders", ("o_orderkey",), Q.exists("o_orderpriority"), "o_orderpriority IS NOT NULL")
_predicate("doc_all", "nation", ("n_nationkey", "n_name"), Query.all(), "true")
_predicate("doc_matching", "orders", ("o_orderkey",), Query.matching(lambda _: F.year("o_orderdate") == 1996), "year(o_orderdate) = 1996")
_predicate("doc_and_or", "customer", _CUSTOMER, (Q.eq("c_mktsegment", "BUILDING") | Q.lt("c_acctbal", -500)) & Q.gt("c_nationkey", 3),
           "(c_mktsegment = 'BUILDING' OR c_acctbal < -500) AND c_nationkey > 3")


def _filter(name: str, spec: dict, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.to_query(spec).apply(_events_doc(spark, d), "doc").select("event_id")

    run.__name__ = name
    query(f"SELECT event_id FROM events WHERE {where}")(run)


_filter("filter_eq_strict", {"k": {"$eq": 5}}, f"{_HAS} AND {_K} = 5")
_filter("filter_eq_fraction", {"k": {"$eq": 5.0}}, "false")
_filter("filter_eq_implicit", {"k": 5.0}, f"{_HAS} AND {_K} = 5")
_filter("filter_eq_null", {"k": {"$eq": None}}, f"NOT {_HAS}")
_filter("filter_ne", {"k": {"$ne": 5}}, f"NOT {_HAS} OR {_K} <> 5")
_filter("filter_in", {"k": {"$in": [1, 2, 3.0]}}, f"{_HAS} AND {_K} IN (1, 2)")
_filter("filter_nin", {"k": {"$nin": [1, 2, 3]}}, f"NOT {_HAS} OR {_K} NOT IN (1, 2, 3)")
_filter("filter_range", {"k": {"$gt": 10, "$lte": 60}}, f"{_HAS} AND {_K} > 10 AND {_K} <= 60")
_filter("filter_regex", {"n.t.0": {"$regex": "^(view|cl)"}}, f"{_HAS} AND regexp_matches(event_type, '^(view|cl)')")
_filter("filter_exists", {"k": {"$exists": True}}, "user_id % 2 = 0")
_filter("filter_exists_false", {"k": {"$exists": False}}, "user_id % 2 = 1")
_filter("filter_and_or", {"$or": [{"k": {"$lt": 10}}, {"$and": [{"n.t.0": "click"}, {"k": {"$gte": 50}}]}]},
        f"{_HAS} AND ({_K} < 10 OR (event_type = 'click' AND {_K} >= 50))")
_filter("filter_empty_or", {"$or": []}, "false")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 10")
def filter_window(spark, d):
    e = t(spark, d, "events")
    q = filters.to_query({"sortField": "value", "sortDir": "desc", "limit": 20, "offset": 10})
    return Query(q.predicate, (*q.sort, SortKey("event_id")), q.offset, q.limit).apply(e).select("event_id", "value")


@query("SELECT p_partkey FROM part WHERE p_size > 20")
def filter_legacy(spark, d):
    return filters.legacy_filter({"$gt": {"p_partkey": 5, "p_size": 20}}).apply(t(spark, d, "part")).select("p_partkey")


# --- front ends -----------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, 'A.*L')")
def builder_like(spark, d):
    return dsl.select_from("part").where("p_type").like("A%L").apply(t(spark, d, "part")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def text_query(spark, d):
    return dsl.from_text("c_mktsegment='BUILDING'").apply(t(spark, d, "customer")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderpriority > '1-Z'")
def entity_where_and(spark, d):
    q = dsl.where("o_totalprice >= ? AND o_orderstatus = ? and o_orderpriority <> ? AND o_orderpriority > ?", 1000, "F", "5-LOW", "1-Z")
    return q.apply(t(spark, d, "orders")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_acctbal > 9000) AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 2")
def mapper_fold(spark, d):
    m = dsl.Mapper("Customer").where("c_nationkey").eq("3").or_("c_acctbal").gt(9000).and_("c_mktsegment").eq("BUILDING")
    return m.order_by("-c_acctbal", "c_custkey").skip(2).limit(50).query().apply(t(spark, d, "customer")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b_ild%' AND NOT (c_nationkey IN (1, 2))")
def mapper_ilike_not_in(spark, d):
    m = dsl.Mapper().where("c_mktsegment").like("b_ild%").and_("c_nationkey").not_().is_in([1, "2"])
    return m.query().apply(t(spark, d, "customer")).select("c_custkey")


@query("SELECT user_id, value FROM (SELECT event_id, user_id, CASE WHEN user_id % 2 = 1 THEN value END AS value FROM events) WHERE value IS NULL OR value < 10")
def mapper_null_lowest(spark, d):
    e = t(spark, d, "events").withColumn("value", F.when(F.col("user_id") % 2 == 1, F.col("value")))
    return dsl.Mapper().where("value").lt(10).query().apply(e).select("user_id", "value")


@query(
    "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND lower(o_orderpriority) LIKE '%high%') OR o_orderstatus = 'P' "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
)
def derived_name_query(spark, d):
    o = t(spark, d, "orders")
    name = "findTop25ByOTotalpriceGreaterThanAndOOrderpriorityContainingIgnoreCaseOrOOrderstatusOrderByOTotalpriceDescOOrderkeyAsc"
    return dsl.derived(name, 100000, "HIGH", "P", fields=o.columns).query.apply(o).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_type LIKE 'S%'")
def derived_name_between(spark, d):
    p = t(spark, d, "part")
    q = dsl.derived("findByPSizeBetweenAndPBrandNotInAndPTypeLike", 10, 20, ["Brand#11", "Brand#12"], "S%", fields=p.columns)
    return q.query.apply(p).select("p_partkey")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal < 0")
def derived_count(spark, d):
    c = t(spark, d, "customer")
    return dsl.derived("countByCAcctbalLessThan", 0, fields=c.columns).query.apply(c).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'build%' OR c_nationkey = 7")
def example_probe(spark, d):
    q = dsl.by_example({"c_mktsegment": "Build", "c_nationkey": 7, "c_name": None}, match_all=False, string_match="starting", ignore_case=["c_mktsegment"])
    return q.apply(t(spark, d, "customer")).select("c_custkey")


# --- sorting and paging ----------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def find_sort_offset_limit(spark, d):
    q = (Q.eq("c_mktsegment", "BUILDING") & Q.gte("c_acctbal", 0)).order_by("-c_acctbal", "c_custkey").window(5, 20)
    return Collection(t(spark, d, "customer"), "c_custkey").find(q).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 30 OFFSET 60")
def page_from_zero(spark, d):
    return Query().order_by("p_retailprice", "p_partkey").page(2, 30).apply(t(spark, d, "part")).select("p_partkey")


@query("SELECT event_id, x FROM (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN value END AS x FROM events) ORDER BY x ASC NULLS FIRST, event_id")
def nulls_first_sort(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.col("value")).alias("x"))
    return Query().order_by("x", "event_id").apply(e)


@query("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, lower(s_name), s_suppkey LIMIT 40")
def multi_key_sort(spark, d):
    q = Query().order_by(SortKey("s_nationkey", False, False), SortKey("s_name", ignore_case=True), "s_suppkey").window(0, 40)
    return q.apply(t(spark, d, "supplier")).select("s_suppkey", "s_nationkey")


@query("SELECT count(*) AS count FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 100)")
def count_with_limit(spark, d):
    return Collection(t(spark, d, "orders"), "o_orderkey").count(Q.eq("o_orderstatus", "F").window(0, 100))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 3, 1)")
def find_by_ids(spark, d):
    return Collection(t(spark, d, "orders"), "o_orderkey").find_by_ids([7, 3, -1, 1]).select("o_orderkey", "o_totalprice")


@query("SELECT true AS exists FROM orders WHERE o_orderkey = 1")
def exists_by_id(spark, d):
    return Collection(t(spark, d, "orders"), "o_orderkey").exists(1)


# --- pipeline ---------------------------------------------------------------------


@query("SELECT o_orderpriority AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def pipe_match_group(spark, d):
    p = Pipeline(t(spark, d, "orders"), "o_orderkey").match(Q.eq("o_orderstatus", "F"))
    out = p.group("o_orderpriority", n="count", total=("sum", "o_totalprice"), mean=("avg", "o_totalprice")).execute()
    return out.select("_id", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"))


@query("SELECT p_size AS _id, CAST(sum(p_size) AS DOUBLE) AS sum FROM part GROUP BY 1")
def pipe_group_own_sum(spark, d):
    return Pipeline(t(spark, d, "part"), "p_partkey").group_own("p_size", "sum").execute()


@query("SELECT c_nationkey AS _id, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def pipe_group_min_max(spark, d):
    p = Pipeline(t(spark, d, "customer"), "c_custkey").match(Q.lt("c_acctbal", 0))
    return p.group("c_nationkey", low=("min", "c_acctbal"), high=("max", "c_acctbal")).execute()


@query("SELECT user_id AS _id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS z FROM events GROUP BY 1")
def pipe_group_first_last(spark, d):
    p = Pipeline(t(spark, d, "events"), "event_id", seq="event_id")
    return p.group("user_id", a=("first", "event_type"), z=("last", "event_type")).execute()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pipe_rollup(spark, d):
    p = Pipeline(t(spark, d, "lineitem")).rollup(["l_returnflag", "l_linestatus"], n="count", q=("sum", "l_quantity")).execute()
    return p.select("l_returnflag", "l_linestatus", "n", F.round("q", 2).alias("q"))


def _pipe_total(name: str, op: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = Pipeline(t(spark, d, "lineitem")).match(Q.gt("l_quantity", 25))
        out = p.count("x") if op == "count" else getattr(p, op)("l_extendedprice", "x")
        return out.execute().select(F.round("x", 2).alias("x") if op != "count" else F.col("x"))

    run.__name__ = name
    query(f"SELECT {sql} AS x FROM lineitem WHERE l_quantity > 25")(run)


for _op in ("sum", "avg", "min", "max"):
    _pipe_total(f"pipe_{_op}", _op, f"round({_op}(l_extendedprice), 2)")
_pipe_total("pipe_count", "count", "count(*)")


@query("SELECT n_nationkey AS id, n_name FROM nation")
def pipe_project(spark, d):
    return Pipeline(t(spark, d, "nation"), "n_nationkey").project("n_name", "id").execute()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15 OFFSET 10")
def pipe_sort_skip_limit(spark, d):
    p = Pipeline(t(spark, d, "lineitem")).match(Q.eq("l_returnflag", "R")).sort("-l_extendedprice", "l_orderkey", "l_linenumber")
    return p.skip(10).limit(15).execute().select("l_orderkey", "l_linenumber")


# --- aggregates over rows ------------------------------------------------------------


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 1")
def agg_row_with_min(spark, d):
    return A.row_with(t(spark, d, "part"), "p_retailprice", False, "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def agg_row_with_max(spark, d):
    return A.row_with(t(spark, d, "part"), "p_retailprice", True, "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT CAST(sum(coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0)) AS DOUBLE) AS sum, round(avg(coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0)), 6) AS avg FROM part")
def agg_sum_coerced(spark, d):
    p = t(spark, d, "part").withColumn("x", F.substring("p_brand", 7, 9))
    return A.total(p, "x").select("sum", F.round("avg", 6).alias("avg"))


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def agg_counts_by(spark, d):
    return A.counts_by(t(spark, d, "events"), "event_type")


@query("SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def agg_distinct_rows(spark, d):
    return A.distinct_rows(t(spark, d, "customer"), "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey")


@query("SELECT DISTINCT p_type AS value FROM part")
def agg_distinct_values(spark, d):
    return A.distinct_values(t(spark, d, "part"), "p_type")


@query("SELECT n_regionkey AS value, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def agg_grouped_rows(spark, d):
    g = A.grouped(t(spark, d, "nation"), F.col("n_regionkey"), ["n_name"], ["n_nationkey"])
    return g.select("value", F.size("rows").cast("bigint").alias("n"), F.array_join(F.transform("rows", lambda r: r["n_name"]), ",").alias("names"))


@query(
    "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM s GROUP BY 1"
)
def latency_percentiles(spark, d):
    return A.floor_rank_percentiles(t(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


@query("SELECT user_id, value FROM events ORDER BY value, event_id LIMIT 12")
def agg_ordered(spark, d):
    return A.ordered(t(spark, d, "events"), "value", "event_id").limit(12).select("user_id", "value")


# --- joins ----------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 10")
def enrich_left(spark, d):
    c = t(spark, d, "customer").where("c_nationkey < 10")
    out = J.enrich(t(spark, d, "orders"), c, {"o_custkey": "c_custkey"}, {"c_name": "customer", "c_mktsegment": "segment"})
    return out.select("o_orderkey", "customer", "segment")


@query(
    "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(round(sum(l_quantity * l_extendedprice), 2), 0) AS total, "
    "coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def denormalize_orders(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    out = J.nest_children(
        t(spark, d, "orders"), items, "o_orderkey", "l_orderkey", "items", ["l_linenumber", "l_partkey"], total=F.sum(F.col("l_quantity") * F.col("l_extendedprice"))
    )
    parts = F.array_join(F.transform("items", lambda i: i["l_partkey"].cast("string")), ",")
    return out.select(
        "o_orderkey", F.size("items").cast("bigint").alias("n"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"), parts.alias("parts")
    )


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, d):
    return J.semi(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return J.anti(t(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


@query(
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 NOT IN (0, 1) "
    "UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, 1 FROM customer WHERE c_custkey % 100 = 5"
)
def tx_overlay(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    staged = c.where(k % 10 < 2).select("c_custkey", F.lit(0.0).alias("c_acctbal"), (k % 10 == 1).alias("deleted"))
    new = c.where(k % 100 == 5).select((k + 1000000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit(False).alias("deleted"))
    return J.overlay(c, staged.unionAll(new), "c_custkey")


# --- lists, sets, hashes, counters ------------------------------------------------------


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event types in the order of time."""
    rows = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    return rows.select("user_id", F.transform("r", lambda x: x["event_type"]).alias("items"))


_LISTS = "WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS items FROM events GROUP BY 1) "


def _list(name: str, change: Callable, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = change(F.col("items"))
        kind = _lists(spark, d).select(x.alias("x")).schema["x"].dataType.simpleString()
        return _lists(spark, d).select("user_id", (F.array_join(x, ",") if kind.startswith("array") else x).alias("x"))

    run.__name__ = name
    query(f"{_LISTS} SELECT user_id, {sql} AS x FROM l")(run)


_list("list_push_left", lambda i: L.push_left(i, ["a", "b"]), "'b,a,' || array_to_string(items, ',')")
_list("list_push_right", lambda i: L.push_right(i, ["a", "b"]), "array_to_string(items, ',') || ',a,b'")
_list("list_range", lambda i: L.range_(i, -3, -1), "array_to_string(items[greatest(len(items) - 2, 1):], ',')")
_list("list_range_past_end", lambda i: L.range_(i, 5000, 6000), "items[len(items)]")
_list("list_trim", lambda i: L.trim(i, 1, 3), "array_to_string(items[2:4], ',')")
_list("list_index", lambda i: L.index(i, -2), "CASE WHEN len(items) > 1 THEN items[len(items) - 1] END")
_list("list_length", lambda i: L.length(i).cast("bigint"), "len(items)")
_list("list_pop", lambda i: L.without_last(L.without_first(i)), "array_to_string(items[2:len(items) - 1], ',')")
_list("list_remove_all", lambda i: L.remove(i, 0, "view"), "array_to_string(list_filter(items, lambda v: v <> 'view'), ',')")
_list("list_remove_first", lambda i: L.remove(i, 1, "view"),
      "CASE WHEN list_position(items, 'view') > 0 THEN array_to_string(list_concat(items[:list_position(items, 'view') - 1], items[list_position(items, 'view') + 1:]), ',') ELSE array_to_string(items, ',') END")
_list("list_insert", lambda i: L.insert(i, "click", "new"),
      "CASE WHEN list_position(items, 'click') > 0 THEN array_to_string(list_concat(list_concat(items[:list_position(items, 'click') - 1], ['new']), items[list_position(items, 'click'):]), ',') ELSE array_to_string(items, ',') END")
_list("list_set", lambda i: L.set_at(i, 0, "first"), "array_to_string(list_concat(['first'], items[2:]), ',')")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))


@query("SELECT user_id AS member FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_inter(spark, d):
    return K.set_inter(_members(spark, d), ["click", "error"])


@query("SELECT user_id AS member FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def set_union(spark, d):
    return K.set_union(_members(spark, d), ["click", "error"])


@query("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_diff(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member"))
    return K.set_diff(o, "F", ["P"])


@query("SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'click')) AS rest, bool_or(event_type = 'view') AS has FROM events GROUP BY 1")
def set_arrays(spark, d):
    i = F.col("items")
    return _lists(spark, d).select(
        "user_id", S.size(i).cast("bigint").alias("n"), S.size(S.diff(i, F.array(F.lit("view"), F.lit("click")))).cast("bigint").alias("rest"), S.contains(i, "view").alias("has")
    )


@query("SELECT user_id, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def hash_latest(spark, d):
    log = t(spark, d, "events").select("user_id", F.col("event_type").alias("field"), "value", "event_id")
    return K.fold_hashes(log, "user_id", "field", "value", "event_id").select("user_id", F.explode("fields").alias("field", "value"))


@query("WITH h AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) AS n FROM events GROUP BY 1) SELECT user_id, v + 5 AS views, 2 AS picked FROM h")
def hash_increment(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count("*").alias("n"))
    h = F.create_map(F.lit("views"), F.col("v").cast("string"), F.lit("all"), F.col("n").cast("string"), F.lit("x"), F.lit("1"))
    bumped = M.increment(h, "views", 5)
    return e.select("user_id", M.get(bumped, "views").cast("bigint").alias("views"), F.size(M.get_many(bumped, ["views", "all", "none"])).alias("picked"))


@query("SELECT user_id AS key, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY 1")
def kv_counter(spark, d):
    k = F.col("event_type")
    log = t(spark, d, "events").select(F.col("user_id").alias("key"), F.when(k == "view", 1).when(k == "error", -1).otherwise(0).alias("delta"))
    return K.counters(log)


def _kv(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user; it lapses five days later, those of purchases never."""
    at = F.unix_millis(F.col("ts").cast("timestamp")) + 5 * 86_400_000
    e = t(spark, d, "events").select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_type") != "purchase", at).alias("expires_at"),
    )
    return K.latest(e)


_KV = (
    "WITH e AS (SELECT 'user:' || user_id AS key, event_type AS value, CASE WHEN event_type <> 'purchase' THEN epoch_us(ts) // 1000 + 5 * 86400000 END AS expires_at, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), s AS (SELECT * FROM e WHERE r = 1) "
)


@query(f"{_KV} SELECT key, value FROM s WHERE expires_at IS NULL OR expires_at >= {NOW + 10 * 86_400_000}")
def kv_latest_ttl(spark, d):
    return K.get_live(_kv(spark, d), F.lit(NOW + 10 * 86_400_000)).select("key", "value")


@query(f"{_KV} SELECT key, expires_at IS NOT NULL AS has_ttl, expires_at, coalesce(expires_at < {NOW + 18 * 86_400_000}, false) AS expired FROM s WHERE key LIKE 'user:1%'")
def kv_by_prefix(spark, d):
    return K.by_prefix(_kv(spark, d), "user:1", F.lit(NOW + 18 * 86_400_000))


@query(f"{_KV} SELECT count(*) AS total, count(*) FILTER (expires_at < {NOW + 19 * 86_400_000}) AS expired, count(*) FILTER (expires_at IS NULL OR expires_at >= {NOW + 19 * 86_400_000}) AS active FROM s")
def kv_stats(spark, d):
    return K.bucket_stats(_kv(spark, d), F.lit(NOW + 19 * 86_400_000))


@query(f"{_LISTS} SELECT user_id AS key, items[len(items)] AS head, len(items) AS n FROM l")
def list_from_log(spark, d):
    log = t(spark, d, "events").select(F.col("user_id").alias("key"), F.lit("lpush").alias("op"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("seq"))
    return K.fold_lists(log).select("key", L.first(F.col("items")).alias("head"), L.length(F.col("items")).cast("bigint").alias("n"))


# --- wide columns -----------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A row for each user, a cell for each event; cells of errors lapse at once, others never."""
    return t(spark, d, "events").select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("row_key"),
        F.concat("event_type", F.lit("_"), "event_id").alias("column"), F.col("event_id").alias("ord"),
        F.col("value").cast("string").alias("value"), F.lit(None).cast("int").alias("ttl"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(F.col("event_type") == "error", F.lit(NOW - 1)).cast("bigint").alias("expires_at"),
    )


_CELLS = (
    "WITH c AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS row_key, event_type || '_' || event_id AS col, event_id AS ord, event_type = 'error' AS gone FROM events) "
)


@query(f"{_CELLS} SELECT col AS \"column\" FROM c WHERE row_key = 'u0007' AND NOT gone ORDER BY ord LIMIT 10 OFFSET 3")
def cf_row_page(spark, d):
    return W.row_page(_cells(spark, d), "u0007", 10, 3, F.lit(NOW)).select("column")


@query(f"{_CELLS} SELECT col AS \"column\" FROM c WHERE row_key = 'u0011' AND NOT gone AND col LIKE 'view\\_%' ESCAPE '\\'")
def cf_prefix(spark, d):
    return W.select_columns(_cells(spark, d), "u0011", F.lit(NOW), prefix="view_").select("column")


@query(f"{_CELLS} SELECT col AS \"column\" FROM c WHERE row_key = 'u0011' AND NOT gone AND regexp_full_match(col, '(click|view)_[0-9]*5')")
def cf_pattern(spark, d):
    return W.select_columns(_cells(spark, d), "u0011", F.lit(NOW), pattern="(click|view)_[0-9]*5").select("column")


@query(f"{_CELLS} SELECT row_key, count(*) AS n FROM c WHERE NOT gone AND row_key IN (SELECT DISTINCT row_key FROM c WHERE row_key BETWEEN 'u0010' AND 'u0090' ORDER BY row_key LIMIT 20) GROUP BY 1")
def cf_slice(spark, d):
    return W.row_slice(_cells(spark, d), "u0010", "u0090", 20, F.lit(NOW)).groupBy("row_key").agg(F.count("*").alias("n"))


@query(
    f"{_CELLS}, r AS (SELECT row_key, count(*) AS n, count(*) FILTER (gone) AS e FROM c GROUP BY 1) "
    'SELECT count(*) AS "rows", CAST(sum(n) AS BIGINT) AS columns, CAST(sum(e) AS BIGINT) AS expired, CAST(sum(n) // count(*) AS BIGINT) AS avg_columns, min(n) AS min_columns, max(n) AS max_columns FROM r'
)
def cf_stats(spark, d):
    return W.stats(_cells(spark, d), F.lit(NOW)).select("rows", "columns", "expired", "avg_columns", "min_columns", "max_columns")


@query(f"{_CELLS} SELECT row_key, count(*) AS n, string_agg(col, ',' ORDER BY ord) AS cols FROM c WHERE NOT gone GROUP BY 1")
def cf_row_map(spark, d):
    m = W.row_map(_cells(spark, d), F.lit(NOW))
    return m.select("row_key", F.size("columns").cast("bigint").alias("n"), F.array_join(F.map_keys("columns"), ",").alias("cols"))


# --- text --------------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: length(w) > 1 AND w NOT IN ("
_TOKENS += "'a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from', 'as', 'is', 'was', 'are', 'were', "
_TOKENS += "'been', 'be', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'can', 'this', "
_TOKENS += "'that', 'these', 'those'))"


@query(
    "WITH d AS (SELECT doc_id, trim(lower(text), chr(32) || chr(10) || chr(9)) AS x FROM documents), w AS (SELECT doc_id, x, string_split_regex(x, '\\s+') AS ws FROM d), "
    "s AS (SELECT doc_id, (CASE WHEN contains(x, 'the') THEN 1 + 0.5 * len(list_filter(ws, lambda z: z = 'the')) + CASE WHEN starts_with(x, 'the') THEN 2 ELSE 0 END + 1.0::DOUBLE / len(ws) ELSE 0 END "
    "+ CASE WHEN contains(x, 'ent') THEN 1 + 0.5 * len(list_filter(ws, lambda z: z = 'ent')) + CASE WHEN starts_with(x, 'ent') THEN 2 ELSE 0 END + 1.0::DOUBLE / len(ws) ELSE 0 END) / 9.0::DOUBLE AS s FROM w) "
    "SELECT doc_id, round(s, 6) AS score FROM s WHERE s >= 0.1 ORDER BY round(s, 6) DESC, doc_id LIMIT 10"
)
def text_score_topk(spark, d):
    docs = TI.scored(t(spark, d, "documents").select("doc_id", "text"), "the ent")
    return docs.select("doc_id", F.round("score", 6).alias("score")).where("score >= 0.1").orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT p_partkey, levenshtein(lower(p_name), 'part 100') AS d, round(1 - levenshtein(lower(p_name), 'part 100') / greatest(length(p_name), 8)::DOUBLE, 6) AS s FROM part")
def fuzzy_similarity(spark, d):
    q = F.lit("Part 100")
    return t(spark, d, "part").select(
        "p_partkey", F.levenshtein(F.lower("p_name"), F.lower(q)).cast("bigint").alias("d"), F.round(X.similarity(F.col("p_name"), q), 6).alias("s")
    )


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT doc_id AS id FROM t WHERE list_contains(ts, 'tion') AND list_contains(ts, 'ing')")
def text_index_and(spark, d):
    index = TI.postings(t(spark, d, "documents"), "doc_id", "text")
    return TI.search_all(index, "the tion ing notinanydocumentatall")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT doc_id AS id FROM t WHERE contains(',' || array_to_string(ts, ',') || ',', ',tion,ing,') OR contains(',' || array_to_string(ts, ',') || ',', ',er,es,')")
def text_phrase(spark, d):
    return TI.phrase_in(t(spark, d, "documents"), "doc_id", "text", ["tion the ing", None, "er es", "of"])


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT doc_id AS id FROM t WHERE contains(',' || array_to_string(ts, ',') || ',', ',tion,ing,')")
def text_phrase_postings(spark, d):
    return TI.phrase_postings(TI.postings(t(spark, d, "documents"), "doc_id", "text"), "tion and ing")


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1")
def text_vocabulary(spark, d):
    return TI.vocabulary_of(TI.entries(t(spark, d, "documents"), "doc_id", "text"))


# --- vectors --------------------------------------------------------------------------------

_Q = [round(0.1 * ((i * 7) % 11 - 5), 1) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}::FLOAT::DOUBLE" for x in _Q) + "]"


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) DESC, vec_id LIMIT 10")
def knn_cosine(spark, d):
    return V.nearest(t(spark, d, "embeddings"), _Q, 10, "vec_id").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_QSQL}), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QSQL}), vec_id LIMIT 10")
def knn_euclidean(spark, d):
    return V.nearest(t(spark, d, "embeddings"), _Q, 10, "vec_id", metric="euclidean").select("id", F.round("score", 6).alias("score"))


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) SELECT query_id, id, round(s, 5) AS score FROM r WHERE r <= 5"
)
def knn_batch(spark, d):
    e = t(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.nearest_batch(e, queries, 5, "vec_id").select("query_id", "id", F.round("score", 5).alias("score"))


# --- changes --------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(
        F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tombstone")
    )


@query("SELECT user_id AS key, value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def newest_wins(spark, d):
    return C.newest_wins(_versions(spark, d))


@query("SELECT user_id AS key, value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 500) WHERE r = 1 AND event_type <> 'error'")
def snapshot_read(spark, d):
    return C.snapshot(_versions(spark, d), 500, "key", "seq", "tombstone")


@query("SELECT DISTINCT user_id AS key FROM events WHERE user_id < 50 AND user_id IN (SELECT user_id FROM events WHERE event_id > 400)")
def write_conflicts(spark, d):
    v = _versions(spark, d)
    return C.conflicts(v.where("key < 50"), v, 400, "key", "seq")


@query("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def change_feed_since(spark, d):
    return C.since(t(spark, d, "events"), "2024-01-20 00:00:00", "ts").select("event_id", "event_type")


@query(
    "WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 300) "
    "SELECT event_id AS seq FROM v WHERE r = 1 UNION ALL SELECT event_id FROM events WHERE event_id > 300"
)
def vacuum_versions(spark, d):
    return C.vacuum(_versions(spark, d), 300, "key", "seq").select("seq")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS event_type FROM customer WHERE c_custkey % 10 IN (0, 3) UNION ALL SELECT c_custkey + 500000, 'INSERT' FROM customer WHERE c_custkey % 10 = 7")
def change_diff(spark, d):
    a = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey") % 10
    b = a.where(k != 0).withColumn("c_acctbal", F.when(k == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    b = b.unionAll(a.where(k == 7).select((F.col("c_custkey") + 500000).alias("c_custkey"), "c_acctbal"))
    return C.diff(a, b, "c_custkey").select("c_custkey", "event_type")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 'standard' AS tier, round(c_acctbal * 100) AS c_acctbal FROM customer")
def migrate_schema(spark, d):
    steps = [
        SC.Migration(2, "rename", "c_name", "name"), SC.Migration(1, "rename", "c_mktsegment", "segment"), SC.Migration(3, "add", "tier", "standard"),
        SC.Migration(4, "remove", "c_nationkey"), SC.Migration(5, "transform", "c_acctbal", lambda c: F.round(c * 100)),
    ]
    return SC.migrate(t(spark, d, "customer"), steps)[0]


@query(f"SELECT event_id, CASE WHEN user_id % 2 = 1 OR user_id % 10 = 0 THEN 'k: required' ELSE '' END || CASE WHEN user_id % 2 = 1 THEN ';a: unknown' WHEN {_HAS} THEN '' ELSE '' END AS errors FROM events")
def schema_validate(spark, d):
    e = _events_doc(spark, d)
    fields = {"k": SC.Field("integer", True), "n": SC.Field("object")}
    return e.select("event_id", F.array_join(SC.errors(e, fields, strict=True, doc="doc"), ";").alias("errors"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND user_id = 7 AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_filter(spark, d):
    log = t(spark, d, "events").withColumn("operation", F.col("event_type")).withColumn("resource", F.col("user_id").cast("string"))
    return C.audit(log, "purchase", "7", "2024-01-05 00:00:00", 20, "ts", "event_id").select("event_id", "ts")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def upsert_delete(spark, d):
    c = Collection(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    new = c.df.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(0.0))
    return c.upsert(new).delete(Query.matching(F.col("c_custkey") % 5 == 0)).df


@query("SELECT CAST(event_id AS VARCHAR) AS key, value::VARCHAR AS value FROM events WHERE event_id % 4 <> 0 AND event_id > 100")
def wal_replay(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("value").cast("string").alias("v"))
    put = e.select(F.concat_ws("|", F.col("event_id") * 2, F.lit(1), F.lit("PUT"), F.lit("c"), "event_id", "v").alias("value"))
    gone = e.where("event_id % 4 = 0").select(F.concat_ws("|", F.col("event_id") * 2 + 1, F.lit(1), F.lit("DELETE"), F.lit("c"), "event_id", F.lit("")).alias("value"))
    mark = spark.range(1).select(F.lit("201|1|CHECKPOINT|||").alias("value"))
    return LG.replay(LG.recoverable(LG.parse_wal(put.unionAll(gone).unionAll(mark)))).select("key", "value")


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_documents(spark, d):
    e = t(spark, d, "events").select(F.concat(F.lit('{"id": "'), "user_id", F.lit('", "fields": '), "props", F.lit("}")).alias("j"))
    docs = e.select(D.parse(F.col("j")).alias("d")).select("d.*")
    return docs.select("id", source_of(docs, "doc").value("k").num.cast("bigint").alias("k"))


# --- formulas --------------------------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS gross, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END, 4) AS per, "
    "lower(l_returnflag) AS flag FROM lineitem"
)
def formula_fields(spark, d):
    li = t(spark, d, "lineitem")
    f = lambda x: FX.formula(x, source_of(li))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(f("l_quantity * l_extendedprice"), 4).alias("gross"), F.round(f("l_extendedprice / l_discount"), 4).alias("per"),
        f("LOWER(l_returnflag)").alias("flag"),
    )


@query(
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000000 AS seconds, CAST(try_cast(event_type AS INTEGER) AS INTEGER) AS none FROM events"
)
def convert_values(spark, d):
    e = t(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    at = FX.convert(seconds, "instant")
    return e.select(
        "event_id", FX.convert(F.get_json_object("props", "$.k"), "integer").alias("k"), F.unix_seconds(at).alias("seconds"), FX.convert(F.col("event_type"), "integer").alias("none")
    )


@query("SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS versions, max(n) AS most FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def version_counts(spark, d):
    return C.version_counts(_versions(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS with_ttl, count(*) FILTER (event_type = 'error' AND value < 50) AS expired FROM events")
def collection_ttl_stats(spark, d):
    at = F.when(F.col("event_type") == "error", F.when(F.col("value") < 50, NOW - 1).otherwise(NOW + 1)).cast("bigint")
    return Collection(t(spark, d, "events").withColumn("expires_at", at), "event_id", expires_at="expires_at", now=F.lit(NOW)).ttl_stats()


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5 OFFSET 5")
def page_from_one(spark, d):
    q = Q.eq("c_nationkey", 3).hint("FORCE_INDEX").order_by("c_custkey").page_from_one(2, 5)
    return q.apply(t(spark, d, "customer")).select("c_custkey")


@query("SELECT o_orderkey AS id, o_totalprice AS total, upper(o_orderpriority) AS priority FROM orders")
def map_entity(spark, d):
    return SC.map_entity(t(spark, d, "orders"), {"id": "o_orderkey", "total": "o_totalprice", "priority": lambda _: F.upper("o_orderpriority")})


# --- streaming: read to the end of the input, so the SQL of the whole table holds ----------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = t(spark, d, "events").schema
    return feed.read_feed(spark, f"{d}/events.parquet*", schema)


def _result(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to the end of its input, and its result."""
    return feed.run_to_files(df, mode, shared_dir(df.sparkSession, "stream"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = feed.tumbling(_stream(spark, d), "ts", "1 day", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 2))
    return _result(out, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest_state(spark, d):
    out = feed.latest_state(_stream(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return _result(out, "complete")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_change_feed(spark, d):
    return _result(Q.eq("event_type", "purchase").filter(_stream(spark, d)).select("event_id", "user_id"), "append")


@query("SELECT user_id, value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def stream_materialize(spark, d):
    kind = F.when(F.col("event_type") == "error", C.DELETE).otherwise(C.UPDATE)
    changes = _stream(spark, d).select("user_id", "value", F.col("event_id").alias("seq"), kind.alias("event_type"))
    base = shared_dir(spark, "feed")
    feed.materialize(changes, f"{base}/state", f"{base}/log", "user_id").awaitTermination()
    return feed.read_materialized(spark, f"{base}/state")


__all__ = ["ORACLE_SQL", "P", "QUERIES"]
