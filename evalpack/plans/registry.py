"""Registry of driver queries: key -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from . import (catalog, catalog_sql, curate, curate_sql, dedupe, dedupe_sql, facts, facts_sql, inventory,
                   inventory_sql, packs, packs_sql)
    return [(packs, packs_sql), (facts, facts_sql), (dedupe, dedupe_sql), (curate, curate_sql),
            (catalog, catalog_sql), (inventory, inventory_sql)]


def _configured(fn):
    """Apply the session defaults (UTC, AQE, map-key policy, checkpoint dir)
    before the query is built; values the cluster already set are kept."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import configure, ensure_checkpoint_dir
        configure(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for spark_mod, sql_mod in _modules():
        for key in list(sql_mod.queries().keys()) + list(getattr(sql_mod, "ROWS_ONLY", [])):
            out[key] = _configured(getattr(spark_mod, key))
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for _spark_mod, sql_mod in _modules():
        out.update(sql_mod.queries())
    return out
