"""Enhancement plan per pack: value tiers, ordered steps, lift, risks, next
actions. All of it is a projection over the one-row-per-pack profile; the
rule table is a small literal array evaluated with higher-order functions,
so there is no join and no shuffle beyond the profile's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

_DEC = "decimal(10,4)"


def _rules_literal() -> Column:
    return F.array(*[
        F.struct(
            F.lit(r.ordinal).alias("ordinal"), F.lit(r.step_id).alias("step_id"),
            F.lit(r.title).alias("title"), F.lit(r.priority).alias("priority"),
            F.lit(r.automatable).alias("automatable"),
            F.array(*[F.lit(t) for t in r.triggers]).cast("array<string>").alias("triggers"),
            F.lit(r.condition).alias("condition"),
            F.array(*[F.lit(x) for x in r.inputs]).alias("inputs"), F.array(*[F.lit(x) for x in r.outputs]).alias("outputs"),
            F.lit(dims.PRIORITY_LIFT[r.priority]).cast(_DEC).alias("lift"),
        ) for r in dims.STEP_RULES])


def current_tier() -> Column:
    lvl = F.col("readiness_level")
    return (F.when((lvl >= 4) & F.col("s_checker"), F.lit("eval_ready_pack"))
            .when((lvl >= 3) & F.col("s_expectedOutput"), F.lit("benchmark_seed"))
            .when((lvl >= 2) | F.col("s_input"), F.lit("candidate_dataset"))
            .otherwise(F.lit("raw_metadata")))


def target_tier() -> Column:
    return (F.when(F.array_contains("missing_critical", "license"), F.lit("eval_ready_pack"))
            .when(F.col("readiness_level") >= 4, F.lit("commercial_pack"))
            .otherwise(F.lit("eval_ready_pack")))


def plan_steps_column() -> Column:
    """array<struct> of the steps that fire, in rule order; the industry
    step's title names the primary industry."""
    def fires(r: Column) -> Column:
        by_missing = F.arrays_overlap(r["triggers"], F.col("missing"))
        return (F.when(r["condition"] == "always", F.lit(True))
                .when(r["condition"] == "level5", F.col("readiness_level") >= 5)
                .when(r["condition"] == "rag_qa", by_missing & (F.col("task_type") == "rag_qa"))
                .otherwise(F.coalesce(by_missing, F.lit(False))))
    chosen = F.filter(_rules_literal(), fires)
    return F.transform(chosen, lambda r: r.withField(
        "title", F.replace(r["title"], F.lit("{industry}"), F.col("primary_industry"))))


def packaging_risks() -> Column:
    return F.array_compact(F.array(*[
        F.when(F.array_contains("missing", key), F.lit(msg)) for key, msg in dims.PACKAGING_RISKS]))


def next_actions() -> Column:
    cond = [F.when(F.array_contains("missing_critical", k), F.lit(m)) for k, m in dims.NEXT_ACTIONS_IF_MISSING]
    return F.array_distinct(F.array_compact(F.array(*cond, *[F.lit(m) for m in dims.NEXT_ACTIONS_ALWAYS])))


def plan(prof_with_industry: DataFrame) -> DataFrame:
    """Adds ``current_tier, target_tier, steps, lift, packaging_risks,
    next_actions`` to a profile frame that carries ``primary_industry``."""
    out = prof_with_industry.withColumn("current_tier", current_tier()) \
        .withColumn("target_tier", target_tier()) \
        .withColumn("steps", plan_steps_column())
    lift_sum = F.aggregate("steps", F.lit(0).cast(_DEC), lambda acc, s: (acc + s["lift"]).cast(_DEC))
    lift = F.least(F.greatest(F.round(F.col("completeness") + lift_sum, 2), F.lit(0).cast(_DEC)),
                   F.lit(1).cast(_DEC))
    return (out.withColumn("lift", lift.cast("decimal(10,2)"))
            .withColumn("packaging_risks", packaging_risks())
            .withColumn("next_actions", next_actions()))
