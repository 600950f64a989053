import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliant import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    rel = con.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    place = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in place) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).columns


def test_stream_equals_batch(spark):
    columns = ["course", "id", "box", "due", "streak", "learned", "answers"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(columns).collect())
    assert rows(core.stream_relearn(spark, DATA)) == rows(core.relearn_state(spark, DATA).where("course IS NOT NULL"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
