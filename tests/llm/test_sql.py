"""The queries that have SQL, against DuckDB on the smallest tables."""

import os

import pytest

from blockspan.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    sql, df = con.sql(q.oracle_sql()[name]), q.queries()[name](spark, DATA)
    assert set(sql.columns) <= set(df.columns)
    got = df.select(*sql.columns).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(sql.fetchall(), key=str)
