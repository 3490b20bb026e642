"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as e
from blockspan.adapters import testdata as t

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(e.archive.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df, sql = e.queries()[name](spark, DATA), duck.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = e.queries()["block_range_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "o_totalprice" not in plan
    parents = e.queries()["log_parent_txs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in parents


def test_ranges_reach_below_the_window(spark):
    every = t.transactions(spark, DATA)
    some = every.where("block_number >= 3 and block_number < 9")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,3)" in plan and "LessThan(l_orderkey,9)" in plan
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in every.collect() if 3 <= r.block_number < 9)
