"""Queries with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from shelfwatch.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    got, want = (sorted(map(tuple, rows), key=repr) for rows in (df.select(*names).collect(), rel.project(", ".join(names)).fetchall()))
    assert got == want and got
