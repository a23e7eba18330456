"""The nested manifest of a pack: source, summary, industry profile, schema profile with evidence, plan, next actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..sources.scratch import Scratch, stored
from . import discovery
from . import industry as ind
from . import plan as pl
from . import profile as pf


def _signals(prof: DataFrame, cases: DataFrame) -> DataFrame:
    """(pack, signals): twelve entries a pack, in signal order."""
    e = pf.signal_evidence(prof, cases)
    entry = F.struct("ordinal", F.col("signal").alias("key"), "present", F.col("confidence").cast("double").alias("confidence"), "evidence")
    return e.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.dropFields("ordinal")).alias("signals"))


def _industries(cases: DataFrame, facts: DataFrame, taxonomy, scratch: Scratch) -> DataFrame:
    """(pack, primary_industry, is_industry_specific, workflow_focus, industry_matches): at most three matches a pack."""
    matches = scratch.stored(ind.keyword_matches(cases, taxonomy), "matches")
    top = scratch.stored(ind.industry_top(ind.industry_scores(matches, taxonomy), facts, taxonomy), "top")
    hints = ind.taxonomy_dim(cases.sparkSession, taxonomy).select("slug", "workflows")
    full = top.join(discovery.matched_words(matches, taxonomy), ["pack", "slug"], "left").join(hints, "slug", "left")
    entry = F.struct("rank", "slug", "label", F.col("confidence").cast("double").alias("confidence"),
                     F.coalesce("words", F.array().cast("array<string>")).alias("matchedKeywords"), F.col("workflows").alias("workflowHints"))
    full = full.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda m: m.dropFields("rank")).alias("industry_matches"))
    return ind.industry_profile(top, taxonomy).drop("matches").join(full, "pack")


def _number(name: str) -> Column:
    return F.col(name).cast("double")


def nested_manifest(cases: DataFrame, taxonomy=dims.STOCK_TAXONOMY, generated_at: str | None = None, url: Column | None = None) -> DataFrame:
    """(pack, manifest struct) of ``cases`` (pack, seq, raw[, license]). A pack's lists are bounded by the rules and by
    its distinct task types, never by its cases.

    The cases are read twice, for their facts and for keywords; all other steps read these, and one row a pack is stored."""
    scratch = Scratch(cases.sparkSession)
    facts = scratch.stored(pf.case_facts(cases), "facts")
    prof = scratch.stored(pf.profile(facts), "profile")
    full = (prof.join(_industries(cases, facts, taxonomy, scratch), "pack").join(_signals(prof, facts), "pack")
            .join(pf.case_type_lists(facts), "pack", "left"))
    full = stored(full, "packs")
    scratch.drop()
    full = pl.plan(full)
    steps = F.transform("steps", lambda s: F.struct(*[s[a].alias(b) for a, b in (
        ("step_id", "id"), ("title", "title"), ("priority", "priority"), ("automatable", "automatable"), ("inputs", "inputs"), ("outputs", "outputs"))]))
    focus = F.coalesce("workflow_focus", F.array().cast("array<string>"))
    return full.select("pack", F.struct(
        F.lit(dims.MANIFEST_VERSION).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"),
        F.struct(F.col("pack").alias("name"), (F.lit(None).cast("string") if url is None else url).alias("url"),
                 F.col("license_name").alias("licenseName")).alias("source"),
        F.struct(F.col("case_count").alias("caseCount"), pf.ordered_task_types(F.col("task_type"), F.col("case_types")).alias("taskTypes"),
                 _number("completeness").alias("schemaCompleteness"), F.col("readiness_level").cast("int").alias("readinessLevel")).alias("summary"),
        F.struct(F.col("primary_industry").alias("primaryIndustry"), F.col("industry_matches").alias("matches"),
                 F.col("is_industry_specific").alias("isIndustrySpecific")).alias("industryProfile"),
        F.struct(F.col("task_type").alias("taskType"), _number("completeness").alias("completeness"),
                 F.col("readiness_level").cast("int").alias("readinessLevel"), "signals", F.col("evaluators").alias("evaluatorCandidates"),
                 F.col("missing_critical").alias("missingCriticalFields"), "notes").alias("schemaProfile"),
        F.struct(F.col("current_tier").alias("currentTier"), F.col("target_tier").alias("targetTier"),
                 _number("lift").alias("estimatedReadinessLift"), F.col("primary_industry").alias("industry"), focus.alias("workflowFocus"),
                 steps.alias("steps"), F.col("packaging_risks").alias("packagingRisks")).alias("enrichmentPlan"),
        F.col("next_actions").alias("recommendedNextActions")).alias("manifest"))
