import numpy as np
import pytest
from pyspark.sql import functions as F

from karst import more_queries as _more  # noqa: F401  registers its queries with the others
from karst.functions import formula as FX
from karst.functions import lists as L
from karst.functions import maps as M
from karst.functions import sets as S
from karst.functions import text as X
from karst.functions.paths import source_of
from karst.operators import aggregates as A
from karst.operators import changes as C
from karst.operators import families as W
from karst.operators import joins as J
from karst.operators import keyvalue as K
from karst.operators import schema as SC
from karst.operators import textindex as TI
from karst.operators import vectors
from karst.operators import vectors as V
from karst.operators.collection import Collection, stable_page
from karst.operators.database import Database
from karst.operators.pipeline import Pipeline
from karst.operators.transactions import ConflictError, Transaction
from karst.operators.vectors import VectorIndex, nearest
from karst.plans import query as Q
from karst.plans.query import Query
from karst.queries import QUERIES
from karst.sources import documents as D
from karst.sources import logs as LG
from karst.streaming import feed

ORDERS = [("Alice", "Widget", 100.0, 2), ("Bob", "Widget", 50.0, 1), ("Alice", "Gadget", 200.0, 1), ("Bob", "Gadget", 150.0, 3), ("Charlie", "Widget", 75.0, 1)]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(i, *o) for i, o in enumerate(ORDERS)], "id int, customer string, product string, amount double, quantity int")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_pipeline(orders):
    p = Pipeline(orders, seq="id")
    assert {r._id: r["count"] for r in p.group("product").execute().collect()} == {"Widget": 3, "Gadget": 2}
    assert p.sum("amount").execute().first()[0] == 575.0
    assert p.avg("amount").execute().first()[0] == 115.0
    assert (p.min("amount").execute().first()[0], p.max("amount").execute().first()[0]) == (50.0, 200.0)
    assert [r.amount for r in p.sort("-amount").limit(3).execute().collect()] == [200.0, 150.0, 100.0]
    assert p.sort("-amount").skip(2).execute_one().first().amount == 100.0
    assert p.match(Q.eq("product", "Widget").window(0, 1)).count().execute().first()[0] == 3
    g = p.group("customer", a=("first", "product"), z=("last", "product"), s=("sum", "quantity")).execute()
    assert {(r._id, r.a, r.z, r.s) for r in g.collect()} == {("Alice", "Widget", "Gadget", 3.0), ("Bob", "Widget", "Gadget", 4.0), ("Charlie", "Widget", "Widget", 1.0)}
    assert p.project("customer").execute().columns == ["id", "customer"]
    empty = p.match(Q.gt("amount", 1e9))
    assert empty.count("n").execute().first().n == 0
    assert empty.sum("amount").execute().first()[0] == 0.0
    assert empty.max("amount").execute().first()[0] is None


def test_negative_maximum(spark):
    df = spark.createDataFrame([(1, -5.0), (1, -3.0)], "id int, x double")
    assert Pipeline(df).max("x").execute().first()[0] == -3.0


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, "10"), (4, None), (5, "3")], "id int, v string")
    assert A.row_with(df, "v", True, "id").first().id == 3
    assert A.row_with(df, "v", False, "id").first().id == 2
    assert A.total(df, "v").first().asDict() == {"sum": 16.0, "avg": 4.0}
    assert {r.value: r["count"] for r in A.counts_by(df, "v").collect()} == {"3": 2, "x": 1, "10": 1}
    assert sorted(r.id for r in A.distinct_rows(df, "v", "id").collect()) == [1, 2, 3]
    assert [r.id for r in A.ordered(df, "v", "id").collect()] == [2, 4, 1, 5, 3]
    hundred = spark.range(1, 101)
    assert A.floor_rank_percentiles(hundred, "id", [0.5, 0.95, 0.99]).first()[:] == (51, 96, 100)


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (lambda i: L.push_left(i, ["x", "y"]), ["y", "x", "a", "b", "c", "b"]),
        (lambda i: L.push_right(i, ["x"]), ["a", "b", "c", "b", "x"]),
        (lambda i: L.range_(i, 1, 2), ["b", "c"]),
        (lambda i: L.range_(i, -2, -1), ["c", "b"]),
        (lambda i: L.range_(i, 9, 12), ["b"]),
        (lambda i: L.range_(i, 9, 12, clamp=False), []),
        (lambda i: L.range_(i, 0, -99), ["a"]),
        (lambda i: L.trim(i, 1, 99), ["b", "c", "b"]),
        (lambda i: L.trim(i, 7, 9), []),
        (lambda i: L.index(i, -1), "b"),
        (lambda i: L.index(i, 4), None),
        (lambda i: L.set_at(i, -4, "z"), ["z", "b", "c", "b"]),
        (lambda i: L.remove(i, 0, "b"), ["a", "c"]),
        (lambda i: L.remove(i, 1, "b"), ["a", "c", "b"]),
        (lambda i: L.remove(i, -1, "b"), ["a", "b", "c"]),
        (lambda i: L.remove(i, 2, "none"), ["a", "b", "c", "b"]),
        (lambda i: L.insert(i, "b", "n"), ["a", "n", "b", "c", "b"]),
        (lambda i: L.insert(i, "b", "n", before=False), ["a", "b", "n", "c", "b"]),
        (lambda i: L.insert(i, "q", "n"), ["a", "b", "c", "b"]),
        (lambda i: L.without_first(i), ["b", "c", "b"]),
        (lambda i: L.without_last(i), ["a", "b", "c"]),
        (lambda i: L.length(i), 4),
    ],
)
def test_lists(spark, f, expected):
    assert one(spark, f(F.array(*map(F.lit, "abcb")))) == expected


def test_empty_lists(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, L.length(none)) == 0
    assert one(spark, L.first(none)) is None
    assert one(spark, L.without_first(none)) == []
    assert one(spark, L.range_(none, 0, -1)) == []
    assert one(spark, L.push_left(none, ["a", "b"])) == ["b", "a"]
    with pytest.raises(Exception, match="out of range"):
        one(spark, L.set_at(F.array(F.lit("a")), 3, "x"))


def test_sets(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    none = F.lit(None).cast("array<string>")
    assert sorted(one(spark, S.inter(a, b))) == ["b", "c"]
    assert one(spark, S.inter(a, none)) == []
    assert one(spark, S.inter()) == []
    assert sorted(one(spark, S.union(a, b, none))) == ["a", "b", "c", "d"]
    assert one(spark, S.diff(a, b)) == ["a"]
    assert one(spark, S.added(a, ["a", "z"])) == 1
    assert one(spark, S.removed(a, ["a", "z"])) == 1
    assert one(spark, S.size(none)) == 0
    assert one(spark, S.contains(none, "a")) is False
    taken, left = S.pop(a, 2)
    assert one(spark, taken) == ["a", "b"] and one(spark, left) == ["c"]
    assert len(one(spark, S.sample(a, 9))) == 9
    assert one(spark, S.sample(none, 9)) == []


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    none = F.lit(None).cast("map<string,string>")
    assert one(spark, M.set_(m, {"b": "9", "c": "3"})) == {"a": "1", "b": "9", "c": "3"}
    assert one(spark, M.added(m, {"b": "9", "c": "3"})) == 1
    assert one(spark, M.get(m, "q")) is None
    assert one(spark, M.get_many(m, ["a", "q"])) == {"a": "1"}
    assert one(spark, M.delete(m, ["a"])) == {"b": "2"}
    assert one(spark, M.increment(m, "a", 5)) == {"b": "2", "a": "6"}
    assert one(spark, M.increment(none, "n", 0.5)) == {"n": "0.5"}
    assert one(spark, M.set_if_absent(m, "a", "7"))["a"] == "1"
    assert one(spark, M.flat(m)) == ["a", "1", "b", "2"]
    assert one(spark, M.size(none)) == 0
    assert one(spark, M.value_length(m, "a")) == 1


def test_set_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 3)], "key string, member int")
    got = lambda df: sorted(r.member for r in df.collect())
    assert got(K.set_inter(rows, ["a", "b"])) == [2]
    assert got(K.set_inter(rows, ["a", "zz"])) == []
    assert got(K.set_union(rows, ["a", "b"])) == [1, 2, 3]
    assert got(K.set_diff(rows, "b", ["a"])) == [3]


def test_keyvalue(spark):
    log = spark.createDataFrame(
        [("k1", "a", 1, None), ("k1", "b", 2, 500), ("k2", "c", 1, 1500), ("p1", "d", 1, None)], "key string, value string, seq int, expires_at bigint"
    )
    state, now = K.latest(log), F.lit(1000)
    assert {r.key: r.value for r in K.get_live(state, now).collect()} == {"k2": "c", "p1": "d"}
    assert [(r.key, r.has_ttl, r.expired) for r in K.by_prefix(state, "k", now).collect()] == [("k1", True, True), ("k2", True, False)]
    assert K.bucket_stats(state, now).first()[:] == (3, 1, 2)
    assert [r.key for r in K.get_all(state, ["p1", "no", "k2"]).collect()] == ["p1", "k2"]
    steps = [("l", "rpush", "a"), ("l", "lpush", "b"), ("l", "rpush", "c"), ("l", "lpop", None), ("l", "rpop", None)]
    lists = spark.createDataFrame([(*s, i) for i, s in enumerate(steps)], "key string, op string, value string, seq int")
    assert K.fold_lists(lists).first()["items"] == ["a"]
    fields = spark.createDataFrame([("h", "x", "1", 1), ("h", "x", None, 2), ("h", "y", "2", 3)], "key string, field string, value string, seq int")
    assert K.fold_hashes(fields).first().fields == {"y": "2"}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        ("dev-1", "temp", 1, "20", None), ("dev-1", "humidity", 2, "40", None), ("dev-1", "battery", 3, "90", None), ("dev-1", "temp_max", 4, "30", None),
        ("dev-1", "flag", 5, "1", 900), ("dev-2", "flag", 1, "1", 900), ("dev-3", "temp", 1, "19", 1500),
    ]
    return spark.createDataFrame([(*r, None, 0) for r in rows], "row_key string, column string, ord int, value string, expires_at bigint, ttl int, created_at bigint")


def test_families(spark, cells):
    now = F.lit(1000)
    names = lambda df: [r["column"] for r in df.collect()]
    assert names(W.row_page(cells, "dev-1", 2, 1, now)) == ["humidity", "battery"]
    assert names(W.row_page(cells, "dev-1", 0, 0, now)) == []
    assert names(W.select_columns(cells, "dev-1", now, prefix="temp")) == ["temp", "temp_max"]
    assert names(W.select_columns(cells, "dev-1", now, pattern="temp")) == ["temp"]
    assert names(W.select_columns(cells, "dev-1", now, names=["battery", "flag", "temp"])) == ["battery", "temp"]
    assert {r.row_key for r in W.row_slice(cells, "dev-1", None, 2, now).collect()} == {"dev-1"}
    assert {r.row_key for r in W.row_slice(cells, "dev-2", "dev-9", 2, now).collect()} == {"dev-3"}
    maps = W.row_map(cells, now).select("row_key", F.map_keys("columns").alias("names")).collect()
    assert {r.row_key: r.names for r in maps}["dev-1"] == ["temp", "humidity", "battery", "temp_max"]
    s = W.stats(cells, now).first()
    assert (s.rows, s.columns, s.with_ttl, s.expired, s.avg_columns, s.min_columns, s.max_columns) == (3, 7, 3, 2, 2, 1, 5)
    new = spark.createDataFrame([("dev-1", "temp", 9, "25", None, None, 5)], cells.schema)
    temp = W.put(cells, new).where("row_key = 'dev-1' and column = 'temp'").first()
    assert (temp.value, temp.ord) == ("25", 1)
    left = {(r.row_key, r["column"]): r.remaining for r in W.remaining_ttl(cells, now).collect()}
    assert (left["dev-1", "temp"], left["dev-2", "flag"], left["dev-3", "temp"]) == (-1, 0, 0)
    assert W.set_ttl(cells, F.col("row_key") == "dev-2", 60, now).where("row_key = 'dev-2'").first().expires_at == 61000
    assert W.delete(cells, "dev-1", "temp").count() == 6 and W.delete(cells, "dev-1").count() == 2


def test_collection(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 500), (3, "c", 5000)], "id int, v string, expires_at bigint")
    c = Collection(df, expires_at="expires_at", now=F.lit(1000))
    assert sorted(r.id for r in c.find_all().collect()) == [1, 3]
    assert c.find_by_id(2).count() == 0 and c.exists(3).first()[0]
    assert [r.id for r in c.find_by_ids([3, 9, 1, 2]).collect()] == [3, 1]
    assert c.ttl_stats().first()[:] == (3, 2, 1)
    new = spark.createDataFrame([(1, "z", None), (7, "n", None)], df.schema)
    assert {r.id: r.v for r in c.upsert(new).df.collect()} == {1: "z", 3: "c", 7: "n"}
    assert {r.id: r.v for r in c.update(new).df.collect()} == {1: "z", 3: "c"}
    assert [r.id for r in c.delete({"v": "a"}).df.collect()] == [3]
    assert [r.id for r in c.delete(Query().order_by("-id").window(0, 1)).df.collect()] == [1]
    assert c.set_ttl({"id": 1}, 60).raw.where("id = 1").first().expires_at == 61000
    assert {r.id: r.ttl_seconds for r in c.with_remaining_ttl().collect()} == {1: -1, 3: 4}
    merged = c.merge_fields(spark.createDataFrame([(1, "m")], "id int, v string"))
    assert {r.id: r.v for r in merged.df.collect()} == {1: "m", 3: "c"}
    page = stable_page(spark.range(25), [F.col("id").desc()], 1, 10).collect()
    assert [r.id for r in page] == list(range(14, 4, -1))


def test_joins(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    kids = spark.createDataFrame([(1, 2, 3.0), (1, 1, 4.0)], "pk int, line int, price double")
    out = {r.k: r for r in J.nest_children(parents, kids, "k", "pk", "items", ["line"], total=F.sum("price")).collect()}
    assert [i.line for i in out[1]["items"]] == [1, 2] and out[1].total == 7.0
    assert out[2]["items"] == [] and out[2].total is None
    e = J.enrich(parents, kids.where("line = 1"), {"k": "pk"}, {"price": "p"}).collect()
    assert {r.k: r.p for r in e} == {1: 4.0, 2: None}


def test_changes(spark):
    v = spark.createDataFrame([("a", 1, 10, False), ("a", 2, 20, False), ("b", 3, 15, False), ("b", 4, 30, True)], "key string, x int, commit_ts int, deleted boolean")
    assert {r.key: r.x for r in C.snapshot(v, 25).collect()} == {"a": 2, "b": 3}
    assert {r.key: r.x for r in C.snapshot(v, 30).collect()} == {"a": 2}
    assert {r.key for r in C.conflicts(v, v, 15).collect()} == {"a", "b"}
    assert C.conflicts(v, v, 30).count() == 0
    assert sorted(r.x for r in C.vacuum(v, 20).collect()) == [2, 3, 4]
    assert [r.version for r in C.numbered_versions(v, "key", "commit_ts").where("key = 'a'").orderBy("x").collect()] == [1, 2]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id int, v string")
    assert {r.id: r.event_type for r in C.diff(a, b, "id").collect()} == {2: "UPDATE", 3: "INSERT"}


def test_diff_of_states_that_repeat_a_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "p"), (3, "p"), (4, "m"), (4, "n"), (None, "e")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "w"), (2, "y"), (2, "y"), (3, "p"), (4, "q"), (4, "r"), (4, "s"), (None, "e")], "id int, v string")
    got = sorted((r.id, r.event_type, r.previous_value, r.new_value) for r in C.diff(a, b, "id").collect() if r.event_type != "UPDATE")
    row = lambda i, v: f'{{"id":{i},"v":"{v}"}}'
    assert got == [(1, "INSERT", None, row(1, "w")), (2, "INSERT", None, row(2, "y")), (3, "DELETE", row(3, "p"), None), (4, "INSERT", None, row(4, "s"))]
    updates = [(r.previous_value, r.new_value) for r in C.diff(a, b, "id").where("event_type = 'UPDATE'").collect()]
    assert sorted(updates) == [(row(4, "m"), row(4, "q")), (row(4, "n"), row(4, "r"))]


def test_schema(spark):
    df = spark.createDataFrame([("a", 1.0, "t"), (None, None, None)], "name string, price double, flag string")
    fields = {"name": SC.Field("string", True), "price": SC.Field("int"), "flag": SC.Field("boolean")}
    got = [r.e for r in df.select(SC.errors(df, fields).alias("e")).collect()]
    assert got == [["flag: not of type boolean"], ["name: required"]]
    assert df.select(SC.errors(df, {"name": SC.Field()}, strict=True).alias("e")).first().e == ["price: unknown", "flag: unknown"]
    out, version = SC.migrate(df, [SC.Migration(1, "add", "name", "no"), SC.Migration(3, "rename", "flag", "mark")], 0)
    assert out.columns == ["name", "price", "mark"] and version == 3
    assert SC.migrate(df, [SC.Migration(1, "remove", "name")], 1)[0].columns == df.columns


def test_text(spark):
    titles = ["Introduction to Java", "Advanced JavaScript", "Java Performance", "Cooking Basics"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    hits = TI.search(df, "Java", "title", tie="id").collect()
    assert {r.id for r in hits} == {0, 1, 2} and hits[0].id == 2
    assert one(spark, X.score(F.lit(""), "x")) == 0.0
    assert one(spark, X.score(F.lit("nosql"), "nosql")) == pytest.approx(1.0)
    assert one(spark, X.similarity(F.lit("nosql"), F.lit("NOSQUL"))) == pytest.approx(1 - 1 / 6)
    assert one(spark, X.similarity(F.lit(""), F.lit(""))) == 1.0


def test_entries_agree_with_postings(spark):
    texts = [(1, "Red red fox and the fox"), (2, "red hen"), (2, "hen, Red owl"), (3, None), (4, "the a of"), (None, "red elk"), (None, "elk elk"), (5, "x fox")]
    docs = spark.createDataFrame(texts, "id int, body string")
    index, rows = TI.postings(docs, "id", "body"), TI.entries(docs, "id", "body")
    shared = {(r.id, r.shared) for r in rows.collect()}
    assert {(1, False), (2, True), (None, True), (5, False)} <= shared
    counts = {"red": 2, "fox": 2, "hen": 1, "owl": 1, "elk": 0}
    assert {r.token: r.documents for r in TI.vocabulary_of(rows).collect()} == counts
    assert {r.token: r.documents for r in TI.vocabulary(index).collect()} == counts
    gone = spark.createDataFrame([(1,), (7,), (None,)], "id int")
    assert TI.index_size_of(rows).first().size == TI.index_size(index).first().size == 8
    assert TI.index_size_of(rows, gone).first().size == TI.index_size(TI.remove(index, gone)).first().size == 6
    assert TI.index_size_of(rows.limit(0)).first().size == 0
    new = spark.createDataFrame([(2, "gnu gnu"), (9, "gnu fox")], "id int, body string")
    got = TI.vocabulary_of(TI.add_entries(docs, new, "id", "body")).collect()
    want = TI.vocabulary(TI.add(index, new, "id", "body")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} == {("red", 1), ("fox", 3), ("elk", 0), ("gnu", 2)}


def _most_rows(df):
    """The most rows that an exchange or an aggregate of df made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        metric = {"ShuffleExchangeExec": "shuffleRecordsWritten", "HashAggregateExec": "numOutputRows"}.get(kind)
        if metric is not None:
            most = max(most, node.metrics().get(metric).get().value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("name", ["text_vocabulary", "text_index_add", "text_index_size"])
def test_pairs_of_token_and_document_stay_where_they_are(spark, tmp_path, name):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[(i * j) % 60] for j in range(1, 50))) for i in range(1000)]
    pairs = sum(len(set(text.split())) for _, text in docs)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    # each id, and each token once for a task, but no pair of both
    assert 60 <= _most_rows(QUERIES[name](spark, str(tmp_path))) < 2000 < pairs / 4


def test_phrases(spark):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "brown quick"), (3, "quick the brown"), (4, None)], "id int, t string")
    ids = lambda d: sorted(r.id for r in d.collect())
    index = TI.postings(df, "id", "t")
    for phrase, expected in (("quick brown", [1, 3]), ("brown quick", [2]), ("the", []), ("", []), ("fox brown", [])):
        assert ids(TI.phrase_in(df, "id", "t", [phrase])) == expected
        assert ids(TI.phrase_postings(index, phrase)) == expected
    assert ids(TI.phrase_in(df, "id", "t", [None, "brown fox", "brown quick"])) == [1, 2]
    assert ids(TI.search_all(index, "brown unknownword quick")) == [1, 2, 3]
    assert ids(TI.search_all(index, "unknownword")) == []
    assert TI.index_size(index).first().size == 7


def test_vectors(spark):
    e1, e2 = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    df = spark.createDataFrame([(1, e1), (2, e2), (3, [0.9, 0.1] + [0.0] * 6), (4, [0.0] * 8)], "id bigint, embedding array<float>")
    q = [0.95, 0.05] + [0.0] * 6
    assert [r.id for r in V.nearest(df, q, 2).collect()] == [1, 3]
    assert [r.id for r in V.nearest(df, q, 4).collect()][-1] == 4
    assert {r.id for r in V.nearest(df, q, 2, metric="euclidean").collect()} == {1, 3}
    queries = spark.createDataFrame([(10, q), (11, e2)], "query_id bigint, vector array<float>")
    got = {}
    for r in V.nearest_batch(df, queries, 2).orderBy("query_id", F.desc("score")).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {10: [1, 3], 11: [2, 3]}
    assert V.nearest_batch(df, queries.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="above"):
        V.nearest(df, q, 0)


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 0.0, "Ab")], "a double, b double, s string")
    f = lambda x: df.select(FX.formula(x, source_of(df)).alias("x")).first().x
    assert (f("a * 2"), f("a/b"), f("a - b"), f("UPPER(s)"), f("lower(s)"), f("s"), f("s * 2")) == (12.0, 0.0, 6.0, "AB", "ab", "Ab", None)
    assert one(spark, FX.instant(F.lit(1_700_000_000))) == one(spark, FX.instant(F.lit(1_700_000_000_000)))


def test_documents(spark, tmp_path):
    lines = ['{"id": "1", "fields": {"a": 1}, "expiresAt": 5}', '{"id": "2", "a": 2}', "[1]", "junk", '{"a": 3}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    docs = D.read_json_lines(spark, str(tmp_path / "d.json")).collect()
    assert len(docs) == 3 and {d.expires_at for d in docs} == {5, None} and all(d.id for d in docs)
    rows = spark.createDataFrame([('[{"id": "x"}, 5, {"id": "y"}]',)], "value string")
    parsed, counts = D.bulk(rows)
    assert sorted(r.id for r in parsed.collect()) == ["x", "y"] and counts.first()[:] == (2, 1)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert {r.collection: r.documents for r in D.backup({"t": t, "u": t.limit(1)}, str(tmp_path / "b")).collect()} == {"t": 2, "u": 1}
    assert D.restore(spark, str(tmp_path / "b"), "t", t.schema).count() == 2


def test_wal(spark):
    lines = ["1|0|PUT|c|a|x|y", "bad", "2|0|CHECKPOINT|||", "3|0|PUT|c|b|v|w", "4|0|DELETE|c|a|", "5|0|PUT|c|a2|z"]
    wal = LG.parse_wal(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.key: r.value for r in LG.replay(LG.recoverable(wal)).collect()} == {"b": "v|w", "a2": "z"}


def test_compact(spark, tmp_path):
    LG.compact(spark.range(100).withColumn("k", (F.col("id") * 7) % 100), str(tmp_path / "c"), "k", 3)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 100


def test_streams(spark, tmp_path):
    schema = "k string, v int, seq int, event_type string, ts timestamp"
    rows = [("a", 1, 1, "UPDATE", "2024-01-01 00:00:00"), ("b", 2, 2, "UPDATE", "2024-01-01 00:10:00"), ("a", 3, 3, "UPDATE", "2024-01-01 02:00:00"), ("b", 0, 4, "DELETE", "2024-01-01 02:01:00")]
    df = spark.createDataFrame(rows, "k string, v int, seq int, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.where("seq <= 2").coalesce(1).write.mode("append").parquet(src)
    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    stream = lambda: feed.read_feed(spark, src, schema)
    feed.materialize(stream(), state, log, "k").awaitTermination()
    df.where("seq > 2").coalesce(1).write.mode("append").parquet(src)
    feed.materialize(stream(), state, log, "k").awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(f"{state}/version=1").collect()} == {"a": 3}
    feed.write_events(feed.as_changes(stream(), "k", "seq", "c"), str(tmp_path / "out"), str(tmp_path / "out_log")).awaitTermination()
    assert LG.read_events(spark, str(tmp_path / "out")).count() == 4
    seen = []
    feed.subscribe(stream(), lambda b, n: seen.append(b.count()), str(tmp_path / "sub")).awaitTermination()
    assert sum(seen) == 4
    for name, q, mode in (
        ("sess", feed.sessions(stream(), "ts", "30 minutes", ["k"], n=F.count("*")), "complete"),
        ("once", feed.once_each(stream(), "ts", ["k"]).select("k"), "append"),
    ):
        q.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sess").count() == 4 and spark.table("once").count() == 2


def test_database(spark, orders):
    db = Database(spark, "/root/testdata/sf0.001")
    db.register("o", orders)
    assert db.collection("nation", id_col="n_nationkey").find({"n_nationkey": 3}).count() == 1
    assert db.ensure("empty", "id string").find_all().count() == 0
    assert db.names() == ["empty", "nation", "o"]
    assert db.sql("select count(*) from o").first()[0] == 5
    plan = db.explain(db.collection("nation").find({"n_nationkey": 3}))
    assert any("n_nationkey" in p for p in plan["pushed_filters"])
    with pytest.raises(KeyError):
        Database(spark).collection("nope")


def test_transaction_conflict(spark):
    v = spark.createDataFrame([("a", 1, 10, False), ("b", 2, 30, False)], "key string, value int, commit_ts bigint, deleted boolean")
    tx = Transaction(v, 20).put(v.where("key = 'b'").select("key", F.lit(9).alias("value")))
    with pytest.raises(ConflictError):
        tx.commit(40)
    assert tx.rollback() is v
    tx = Transaction(v, 30).put(v.where("key = 'b'").select("key", F.lit(9).alias("value"))).delete(v.where("key = 'b'").select("key"))
    assert [r.key for r in tx.read().collect()] == ["a"]
    assert tx.commit(40).where("commit_ts = 40").select("key", "value", "deleted").collect() == [("b", None, True)]


def test_vector_dimensions(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id bigint, embedding array<float>")
    index = VectorIndex(e, 2)
    for wrong in (lambda: index.search([1.0], 1), lambda: index.search([1.0, 0.0], 1, accuracy=0.0), lambda: index.search([1.0, 0.0], 0), lambda: VectorIndex(e, 0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="dimensions"):
        nearest(e, [1.0, 0.0, 0.0], 1).collect()
    with pytest.raises(Exception, match="dimensions"):
        index.add(spark.createDataFrame([(4, [1.0])], e.schema)).df.collect()
    assert index.stats().first().asDict() == {"size": 3, "dims": 2, "zero_vectors": 1}


def test_batch_neighbours_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 64)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (300, 3)).astype(float)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(3)
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    for metric in ("cosine", "euclidean"):
        got = {}
        for r in sorted(vectors.nearest_batch(e, q, 4, metric=metric).collect(), key=lambda r: (r.query_id, -r.score if metric == "cosine" else r.score, r.id)):
            got.setdefault(r.query_id, []).append((round(r.score, 4), r.id))
        for i in range(0, 300, 20):
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1)
                s = [(-round(float(x[i] @ y / (n[i] * m)), 4), k) for k, (y, m) in enumerate(zip(x, n)) if m > 0] if n[i] else [(0.0, k) for k in range(300) if n[k] > 0]
                want = [(-a, k) for a, k in sorted(s)[:4]]
            else:
                want = sorted((round(float(np.linalg.norm(x[i] - y)), 4), k) for k, y in enumerate(x))[:4]
            assert [a for a, _ in got[i]] == pytest.approx([a for a, _ in want], abs=1e-3)


def test_materialized_state_of_several_batches(spark, tmp_path):
    schema = "key string, value int, seq bigint, event_type string"
    for n, rows in enumerate(([("a", 1, 1, "INSERT"), ("b", 2, 2, "INSERT")], [("a", 5, 3, "UPDATE"), ("b", None, 4, "DELETE"), ("c", 7, 5, "INSERT")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = feed.read_feed(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
        feed.materialize(changes, str(tmp_path / "state"), str(tmp_path / "log"), "key").awaitTermination()
    got = {(r.key, r.value) for r in feed.read_materialized(spark, str(tmp_path / "state")).collect()}
    assert got == {("a", 5), ("c", 7)}


def test_unknown_entities_and_drop(spark):
    db = Database(spark)
    assert db.entities("none").find().count() == 0 and db.names() == [] and not db.drop("none")
    db.register("some_entities", spark.range(3), id_col="id")
    assert db.entities("some_entities").find_one({"id": 2}).first().id == 2 and db.drop("some_entities") and db.names() == []
