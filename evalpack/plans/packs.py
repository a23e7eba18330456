"""Pack readiness jobs over the driver tables (profile, industry, plan,
manifest). Stand-in: a pack is ``documents.source``, a case one document.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``packs_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import industry as ind
from ..operators import plan as pl
from ..operators import profile as pf
from ..sources.scratch import stored
from ..sources.tables import documents_as_cases, license_from_text, table

TAXONOMY = dims.STANDIN_TAXONOMY


def _prof(spark: SparkSession, sf: str) -> DataFrame:
    return pf.profile(documents_as_cases(spark, sf))


def _dbl(c: str):
    return F.col(c).cast("double").alias(c)


def signal_profile(spark, sf):
    long = pf.signals_long(_prof(spark, sf))
    return long.select("pack", F.col("ordinal").cast("int").alias("ordinal"), "signal", "present",
                       F.col("confidence").cast("double").alias("confidence"))


def pack_completeness(spark, sf):
    return _prof(spark, sf).select("pack", "case_count", _dbl("completeness"))


def readiness_level(spark, sf):
    return _prof(spark, sf).select("pack", _dbl("completeness"), F.col("readiness_level").cast("int"))


def task_type_by_pack(spark, sf):
    return _prof(spark, sf).select("pack", "task_type")


def missing_critical(spark, sf):
    return _prof(spark, sf).select("pack", F.array_join("missing_critical", ",").alias("missing_critical"))


def missing_signals(spark, sf):
    """Set difference: all signals except the present ones, in signal order."""
    p = _prof(spark, sf)
    allk = F.array(*[F.lit(k) for k in pf.SIGNAL_KEYS])
    return p.select("pack", F.array_join(F.array_except(allk, "present"), ",").alias("missing"))


def evaluator_candidates(spark, sf):
    return _prof(spark, sf).select("pack", F.array_join("evaluators", ",").alias("evaluators"))


def profile_notes(spark, sf):
    return _prof(spark, sf).select("pack", F.array_join("notes", " | ").alias("notes"))


def pack_license(spark, sf):
    return _prof(spark, sf).select("pack", "license_name")


def license_per_doc(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", license_from_text("text").alias("license_name"))


def signal_hits(spark, sf):
    """Per case: which signal patterns hit its text (P2), in signal order."""
    docs = table(spark, sf, "documents")
    text = F.lower("text")
    hits = F.array_compact(F.array(*[
        F.when(text.rlike(p), F.lit(k)) for k, _w, _f, p in dims.SIGNALS if p is not None]))
    return docs.select("doc_id", F.array_join(hits, ",").alias("signals"))


def task_types_ordered(spark, sf):
    cases = documents_as_cases(spark, sf)
    out = pf.task_types_ordered(cases, pf.profile(cases))
    return out.select("pack", F.array_join("task_types", ",").alias("task_types"))


def _json_cases(spark, sf) -> DataFrame:
    from .inventory import json_cases
    return json_cases(spark, sf).select("pack", "seq", "raw")


def json_signal_profile(spark, sf):
    """The signal profile over JSON cases, whose fields, types, messages and licenses count."""
    long = pf.signals_long(pf.profile(_json_cases(spark, sf)))
    return long.select("pack", F.col("ordinal").cast("int").alias("ordinal"), "signal", "present", _dbl("confidence"))


def json_pack_profile(spark, sf):
    p = pf.profile(_json_cases(spark, sf))
    return p.select("pack", "case_count", _dbl("completeness"), F.col("readiness_level").cast("int").alias("readiness_level"), "task_type",
                    "license_name", "explicit_type", F.array_join("missing_critical", ",").alias("missing_critical"),
                    F.array_join("evaluators", ",").alias("evaluators"), F.array_join("notes", " | ").alias("notes"))


def json_task_types(spark, sf):
    cases = _json_cases(spark, sf)
    out = pf.task_types_ordered(cases, pf.profile(cases))
    return out.select("pack", F.array_join("task_types", ",").alias("task_types"))


def signal_evidence(spark, sf):
    """Evidence of each signal and the first cases that show it, fields before text."""
    facts = stored(pf.case_facts(_json_cases(spark, sf)), "facts")
    e = pf.signal_evidence(pf.profile(facts), facts)
    shown = F.transform("first_cases", lambda c: F.concat_ws(":", c["seq"].cast("string"), c["kind"]))
    return e.select("pack", F.col("ordinal").cast("int").alias("ordinal"), "signal", "present", F.array_join("evidence", ",").alias("evidence"),
                    F.array_join(shown, ",").alias("first_cases"))


def _matches(spark, sf):
    return ind.keyword_matches(documents_as_cases(spark, sf), TAXONOMY)


def keyword_matches(spark, sf):
    return _matches(spark, sf).select("pack", "slug", "kind", "keyword")


def industry_scores(spark, sf):
    s = ind.industry_scores(_matches(spark, sf), TAXONOMY)
    return s.select("pack", "slug", "n_keywords", "n_workflows", _dbl("confidence"))


def _top(spark, sf):
    cases = documents_as_cases(spark, sf)
    scores = ind.industry_scores(ind.keyword_matches(cases, TAXONOMY), TAXONOMY)
    return ind.industry_top(scores, cases, TAXONOMY)


def industry_top3(spark, sf):
    return _top(spark, sf).select("pack", F.col("rank").cast("int").alias("rank"), "slug", _dbl("confidence"))


def _planned(spark, sf):
    cases = documents_as_cases(spark, sf)
    prof = pf.profile(cases)
    scores = ind.industry_scores(ind.keyword_matches(cases, TAXONOMY), TAXONOMY)
    indp = ind.industry_profile(ind.industry_top(scores, cases, TAXONOMY), TAXONOMY)
    return pl.plan(prof.join(indp, "pack", "left")), cases


def value_tiers(spark, sf):
    return _planned(spark, sf)[0].select("pack", "current_tier", "target_tier")


def plan_steps(spark, sf):
    p = _planned(spark, sf)[0]
    return (p.select("pack", F.explode("steps").alias("s"))
            .select("pack", F.col("s.ordinal").cast("int").alias("step_ordinal"), F.col("s.step_id").alias("step_id"),
                    F.col("s.priority").alias("priority"), F.col("s.automatable").alias("automatable"),
                    F.col("s.title").alias("title"), F.array_join("s.inputs", ",").alias("inputs"),
                    F.array_join("s.outputs", ",").alias("outputs")))


def readiness_lift(spark, sf):
    return _planned(spark, sf)[0].select("pack", _dbl("completeness"), _dbl("lift"))


def packaging_risks(spark, sf):
    return _planned(spark, sf)[0].select("pack", F.array_join("packaging_risks", " | ").alias("risks"))


def next_actions(spark, sf):
    return _planned(spark, sf)[0].select("pack", F.array_join("next_actions", " | ").alias("actions"))


def manifest_frame(cases: DataFrame, taxonomy=TAXONOMY) -> DataFrame:
    """Flat manifest summary, one row per pack (A16)."""
    prof = pf.profile(cases)
    scores = ind.industry_scores(ind.keyword_matches(cases, taxonomy), taxonomy)
    indp = ind.industry_profile(ind.industry_top(scores, cases, taxonomy), taxonomy)
    planned = pl.plan(prof.join(indp, "pack", "left"))
    planned = planned.join(pf.case_type_lists(cases), "pack", "left") \
        .withColumn("task_types", pf.ordered_task_types(F.col("task_type"), F.col("case_types")))
    return planned.select(
        F.lit(dims.MANIFEST_VERSION).alias("schema_version"),
        "pack",
        "case_count",
        F.array_join("task_types", ",").alias("task_types"),
        _dbl("completeness"),
        F.col("readiness_level").cast("int").alias("readiness_level"),
        "license_name",
        "primary_industry",
        "is_industry_specific",
        F.array_join("workflow_focus", ",").alias("workflow_focus"),
        "current_tier",
        "target_tier",
        _dbl("lift"),
        F.size("steps").cast("int").alias("n_steps"),
        F.array_join(F.transform("steps", lambda s: s["step_id"]), ",").alias("step_ids"),
        F.array_join("evaluators", ",").alias("evaluators"),
        F.array_join("missing_critical", ",").alias("missing_critical"),
        F.array_join("next_actions", " | ").alias("next_actions"),
    )


def pack_manifest(spark, sf):
    return manifest_frame(documents_as_cases(spark, sf))


def manifest_nested(spark, sf):
    """The nested manifest of each pack of JSON cases, read back from its JSON document."""
    from ..operators.manifest import nested_manifest
    cases = _json_cases(spark, sf)
    m = nested_manifest(cases, TAXONOMY, url=F.concat(F.lit("landed/"), F.col("pack"), F.lit(".jsonl")))
    doc = m.select("pack", F.to_json("manifest").alias("doc"))
    back = doc.select("pack", F.from_json("doc", m.schema["manifest"].dataType).alias("m"))
    signals = F.transform("m.schemaProfile.signals", lambda s: F.concat_ws(":", s["key"], s["present"].cast("string"), F.array_join(s["evidence"], "+")))
    industries = F.transform("m.industryProfile.matches", lambda i: F.concat_ws(":", i["slug"], i["label"], F.array_join(i["matchedKeywords"], "+")))
    steps = F.transform("m.enrichmentPlan.steps", lambda s: F.concat_ws(":", s["id"], s["priority"], F.array_join(s["outputs"], "+")))
    return back.select(
        "pack", F.col("m.schemaVersion").alias("schema_version"), F.col("m.source.url").alias("url"), F.col("m.source.licenseName").alias("license_name"),
        F.col("m.summary.caseCount").alias("case_count"), F.array_join("m.summary.taskTypes", ",").alias("task_types"),
        F.col("m.summary.schemaCompleteness").alias("completeness"), F.col("m.summary.readinessLevel").alias("readiness_level"),
        F.array_join(industries, ",").alias("industries"), F.col("m.industryProfile.isIndustrySpecific").alias("is_industry_specific"),
        F.array_join(signals, ",").alias("signals"), F.array_join("m.schemaProfile.evaluatorCandidates", ",").alias("evaluators"),
        F.array_join("m.schemaProfile.notes", " | ").alias("notes"), F.col("m.enrichmentPlan.currentTier").alias("current_tier"),
        F.col("m.enrichmentPlan.targetTier").alias("target_tier"), F.col("m.enrichmentPlan.estimatedReadinessLift").alias("lift"),
        F.array_join("m.enrichmentPlan.workflowFocus", ",").alias("workflow_focus"), F.array_join(steps, ",").alias("steps"),
        F.array_join("m.enrichmentPlan.packagingRisks", " | ").alias("risks"), F.array_join("m.recommendedNextActions", " | ").alias("next_actions"))
