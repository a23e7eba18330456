"""Plan-shape checks on every query over the reference's operators: no Cartesian product or
nested-loop join, no Python worker, partial top-N before the shuffle where a
per-group first-N is taken."""

import pytest

from conftest import SMOKE
from evalpack.plans import registry

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_no_cartesian_or_python(spark, key):
    plan = plan_of(registry.queries()[key](spark, SMOKE))
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{key}: {bad}\n{plan}"


@pytest.mark.parametrize("key", ["last_n_per_key", "recent_filings",
                                 "preview_top5", "source_quota"])
def test_partial_top_n_before_shuffle(spark, key):
    plan = plan_of(registry.queries()[key](spark, SMOKE))
    assert "WindowGroupLimit" in plan and "Partial" in plan, plan
