import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from threatquery.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(catalogue.QUERIES) > 100


@pytest.mark.parametrize("name", ["scan_risk_by_level", "category_assign", "seed_two_tier_stats", "split_summary", "roc_auc", "weekly_contribution", "tfidf_top_terms"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SMOKE).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in Path(SMOKE).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, rel = catalogue.QUERIES[name](spark, SMOKE), con.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    at = [rel.columns.index(c) for c in columns]
    assert sorted([clean(r[c]) for c in columns] for r in df.collect()) == sorted([clean(r[i]) for i in at] for r in rel.fetchall())


def test_nothing_else_imports_llm():
    for path in (ROOT / "threatquery").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
