"""The driver's contract, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from karst import queries as core

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in core.ORACLE_SQL:
        cur = con.execute(core.ORACLE_SQL[name])
        at = {d[0]: i for i, d in enumerate(cur.description)}
        assert sorted(at) == columns
        assert got == sorted((tuple(r[at[c]] for c in columns) for r in cur.fetchall()), key=repr)
