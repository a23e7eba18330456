"""Driver contract and a DuckDB oracle spot check on the smallest tables."""

import duckdb

import __spark_entry__ as entry
from conftest import SMOKE
from evalpack.plans import registry
from evalpack.sources.tables import TABLES


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0
    assert {"pack", "completeness", "readiness_level", "primary_industry"} <= set(rows[0].asDict())


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) == 103


def _norm(rows):
    def v(x):
        return round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(v(x) for x in r) for r in rows), key=repr)


def test_oracle_spot_check(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for key in ["pack_manifest", "industry_top3", "latest_fact", "dedupe_jaccard", "token_budget", "catalog_topk",
                "asset_summary", "fallback_search"]:
        df = entry.queries()[key](spark, SMOKE)
        cols = sorted(df.columns)
        got = _norm([tuple(r[c] for c in cols) for r in df.collect()])
        res = con.sql(entry.oracle_sql()[key])
        idx = [res.columns.index(c) for c in cols]
        want = _norm([tuple(r[i] for i in idx) for r in res.fetchall()])
        assert got == want, key
