"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from noticeflow.llm import queries

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, found: sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in sorted(range(len(columns)), key=lambda i: columns[i])) for r in found), key=repr)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
