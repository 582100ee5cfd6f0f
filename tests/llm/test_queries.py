"""Registered queries with oracle SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from tracelake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert got.columns == columns
    key = lambda row: [("" if v is None else f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)) for v in row]
    assert sorted(key(r) for r in got.collect()) == sorted(key(r) for r in want.fetchall())
