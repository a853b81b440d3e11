"""Queries that SQL can express, against DuckDB over the smallest tables."""

from pathlib import Path

import pytest

from threatquery.llm import queries

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SMOKE).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, rel = queries.QUERIES[name](spark, SMOKE), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got and got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
