"""Synthesis and gap-fill runs: prompts, completions in resumable rounds, budget, judge, dedupe, report.

A **completer** turns a table of prompts (slot, attempt, label, system, user) into one
row per prompt (slot, attempt, text, error, prompt_tokens, completion_tokens):
``model_client`` calls a function given by the caller, ``landed`` joins completions
that were landed before by (slot, attempt).

``attempt_rounds`` sends every slot once and then only those still without a parsable
completion. A round's answers are written to a folder that all executors share, and the
round is entered in a log there when its data is complete; a run that finds the log goes
on behind the rounds entered, so no slot of a finished round is sent twice. In the round
that was cut off, prompts may be sent again, under the same label, by which an endpoint
can recognise them.

The counters of a run are observed on the plans that make its tables (``DataFrame.observe``):
the report costs no scan of its own. Failures are a table, as long as they are many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import dims
from ..sources.scratch import Scratch, exists, shared_folder, stored, written
from . import curate as cu
from . import dedupe as dd

Completer = Callable[[DataFrame], DataFrame]
COMPLETION = "text string, error string, prompt_tokens long, completion_tokens long"


# --- completers --------------------------------------------------------------------------------

def model_client(call: Callable[[str, str, str], tuple[str, int, int]], partitions: int | None = None) -> Completer:
    """A completer that calls ``call(system, user, label) -> (text, prompt_tokens, completion_tokens)`` for each
    prompt; what it raises is that prompt's error. ``partitions`` bounds the calls in flight."""
    def answer(system: str, user: str, label: str) -> tuple:
        try:
            text, asked, given = call(system, user, label)
            return text, None, asked, given
        except Exception as e:  # noqa: BLE001 - a failed call is an attempt that failed
            return None, f"{dims.CALL_FAILED}: {e}", None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [answer(*row) for row in zip(pdf["system"], pdf["user"], pdf["label"])]
            out = pd.DataFrame(made, columns=["text", "error", "prompt_tokens", "completion_tokens"])
            out = out.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            yield pd.concat([pdf[["slot", "attempt"]].reset_index(drop=True), out], axis=1)

    def complete(prompts: DataFrame) -> DataFrame:
        prompts = prompts.repartition(partitions) if partitions else prompts
        slot = prompts.schema["slot"].dataType.simpleString()
        return prompts.mapInPandas(run, f"slot {slot}, attempt int, {COMPLETION}")

    return complete


def landed(completions: DataFrame) -> Completer:
    """A completer over landed ``completions`` (slot, attempt, text, prompt_tokens, completion_tokens), joined by
    slot and attempt; a prompt without one fails."""
    def complete(prompts: DataFrame) -> DataFrame:
        got = prompts.select("slot", "attempt").join(completions.withColumn("here", F.lit(True)), ["slot", "attempt"], "left")
        return got.select("slot", "attempt", "text", F.when(F.col("here").isNull(), dims.NO_COMPLETION).alias("error"),
                          "prompt_tokens", "completion_tokens")
    return complete


# --- rounds ------------------------------------------------------------------------------------

def _entered(spark, folder: str) -> dict[int, int]:
    """Attempt -> slots that failed in it, for the rounds entered in the folder's log (at most as many as attempts)."""
    if not exists(spark, f"{folder}/log"):
        return {}
    return dict(spark.read.schema("attempt int, failed long").parquet(f"{folder}/log").collect())


def attempt_rounds(prompts: DataFrame, complete: Completer, folder: str, max_attempts: int = dims.MAX_ATTEMPTS,
                   label: str = "case") -> DataFrame:
    """All attempts (slot, attempt, parsed, prompt_tokens, completion_tokens) of ``prompts`` (slot, system, user)."""
    spark, done, log = prompts.sparkSession, None, _entered(prompts.sparkSession, folder)
    for attempt in range(1, max_attempts + 1):
        path = f"{folder}/attempt-{attempt}"
        if attempt not in log:
            ask = prompts
            if done is not None:
                # no broadcast: Spark takes a slot for as small as its share of the wide, compressed files
                ask = prompts.join(done.where("parsed.ok").select("slot").hint("merge"), "slot", "left_anti")
            ask = ask.select("slot", F.lit(attempt).alias("attempt"), F.concat_ws(
                "-", F.lit(label), F.col("slot").cast("string"), F.lit(attempt)).alias("label"), "system", "user")
            got = cu.with_parsed(complete(ask), "text", "error")
            seen = Observation()
            got = got.select("slot", "attempt", "parsed", "prompt_tokens", "completion_tokens")
            written(got.observe(seen, F.count_if(~F.col("parsed.ok")).alias("failed")), path, mode="overwrite")
            log[attempt] = seen.get["failed"]
            spark.createDataFrame([(attempt, log[attempt])], "attempt int, failed long").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        rows = spark.read.schema(_attempt_schema(prompts)).parquet(path)
        done = rows if done is None else done.unionByName(rows)
        if not log[attempt]:
            break
    return done


def _attempt_schema(prompts: DataFrame) -> str:
    slot = prompts.schema["slot"].dataType.simpleString()
    return (f"slot {slot}, attempt int, parsed struct<ok: boolean, reason: string, case: variant, case_id: string>, "
            "prompt_tokens long, completion_tokens long")


# --- cases -------------------------------------------------------------------------------------

def with_key(case_json: Column, key: str, value_json: Column) -> Column:
    """The JSON object with ``key`` set, in its place if it was there."""
    case = F.from_json(case_json, "map<string,variant>")
    return F.to_json(F.map_concat(case, F.create_map(F.lit(key), F.parse_json(value_json))))


def _metadata(case_json: Column) -> Column:
    return F.get_json_object(case_json, "$.metadata")


def with_provenance(case_json: Column, model: str, spec: str) -> Column:
    """The case with the provenance stamp in its metadata."""
    return with_key(case_json, "metadata", cu.stamp_provenance(_metadata(case_json), F.lit(model), F.lit(spec)))


def with_review(case_json: Column, reason: str) -> Column:
    """The case marked for review in its metadata."""
    meta = F.coalesce(F.from_json(_metadata(case_json), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    mark = F.create_map(F.lit("review"), F.parse_json(F.lit("true")), F.lit("reviewReason"), F.parse_json(F.lit(f'"{reason}"')))
    return with_key(case_json, "metadata", F.to_json(F.map_concat(meta, mark)))


# Our own wording; what is asked follows the rules of the judge.
JUDGE_SYSTEM = ("You review synthetic cases for agent evaluation strictly. Answer with one JSON object only: "
                "pass (boolean), score (number from 0 to 1), reason (string).")
JUDGE_CHECKS = ["every required field is filled with more than a placeholder",
                "a tool named in input or expected is among trace.allowedTools and has a fixture in environment",
                "each criterion of the rubric is concrete and can be checked", "identifiers agree across all fields"]


def judge_prompts(cases: DataFrame, industry: str, task_type: str, threshold: float) -> DataFrame:
    """slot, system, user for each case (slot, case JSON)."""
    checks = "\n".join(f"{i}. {c}" for i, c in enumerate(JUDGE_CHECKS, 1))
    ask = (f"Judge this synthesised case of industry {industry}, task type {task_type}. It passes from a score of {threshold}.\n"
           f"Check:\n{checks}\nCase:\n")
    return cases.select("slot", F.lit(JUDGE_SYSTEM).alias("system"), F.concat(F.lit(ask), "case").alias("user"))


# --- the run -----------------------------------------------------------------------------------

@dataclass
class Spec:
    name: str
    industry: str = dims.INDUSTRY_FALLBACK_SLUG
    task_type: str = "custom"
    mode: str = dims.SPEC_DEFAULT_MODE


@dataclass
class Run:
    """``cases`` (slot, case_id, case JSON, attempts, review, review_reason), ``failures`` (slot, reason), ``report`` (one row)."""
    cases: DataFrame
    failures: DataFrame
    report: DataFrame


REPORT = ("spec_name string, model string, mode string, requested long, generated long, failed long, prompt_tokens long, "
          "completion_tokens long, judged long, judge_dropped long, judge_flagged long, deduped_removed long, stopped_by_budget boolean")


def synthesize(prompts: DataFrame, spec: Spec, model: str, complete: Completer, judge: Completer | None = None,
               threshold: float = dims.JUDGE_PASS_THRESHOLD, dedupe: float | None = None, max_tokens: int | None = None,
               folder: str | None = None) -> Run:
    """Runs ``prompts`` (slot long, system, user) of one spec.

    Slots count in the order of ``slot``. Those behind the one that reaches ``max_tokens`` are neither made nor
    failed. ``judge`` drops failing cases and marks those without a verdict for review; ``dedupe`` (a Jaccard
    similarity) keeps the first of near-equal cases. ``generated`` counts what is left behind all of these."""
    spark = prompts.sparkSession
    scratch = Scratch(spark)
    folder = folder or scratch.folder("synthesis")
    attempts = attempt_rounds(prompts, complete, f"{folder}/generate")
    slots = cu.select_attempts(attempts, ["slot"]).withColumn("spec", F.lit(spec.name))
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    if max_tokens is None:
        slots = slots.withColumns({"kept": F.lit(True), "reached": F.lit(False)})
    else:
        # the totals are read twice (buckets and rows), so the slots are made once before
        # the totals need no case; a slot is one row
        slots = scratch.stored(slots.withColumn("tokens", tokens), "synthesis-slots")
        totals = cu.token_budget(slots.select("spec", "slot", "tokens"), ["spec"], "slot", "tokens", max_tokens)
        slots = slots.join(totals.select("slot", "prev_total", "kept"), "slot")
        slots = slots.withColumn("reached", F.col("kept") & (F.col("prev_total") + F.col("tokens") >= max_tokens))
    made, kept = Observation(), F.col("kept")
    case = with_provenance(F.to_json("case"), model, spec.name)
    slots = slots.select("slot", "ok", "attempts", "case_id", F.when(F.col("ok"), case).alias("case"), "prompt_tokens",
                         "completion_tokens", "reason", "kept", "reached")
    slots = scratch.stored(slots.observe(
        made, F.count("*").alias("requested"), F.count_if(kept & F.col("ok")).alias("made"), F.count_if(kept & ~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(kept, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(kept, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.bool_or("reached"), F.lit(False)).alias("stopped")), "synthesis-made")
    failures = stored(slots.where(kept & ~F.col("ok")).select("slot", "reason"), "synthesis-failures")
    none = F.lit(None).cast("string")
    cases = slots.where(kept & F.col("ok")).select("slot", "case_id", "case", "attempts", F.lit(False).alias("review"), none.alias("review_reason"))
    count, extras, before = made.get["made"], {}, [t for t in scratch.tables() if t is not slots]
    scratch.drop(*before)
    if judge is not None:
        answers = judge(judge_prompts(cases, spec.industry, spec.task_type, threshold).select(
            "slot", F.lit(1).alias("attempt"), F.concat_ws("-", F.lit("judge"), F.col("slot").cast("string")).alias("label"), "system", "user"))
        text = F.when(F.col("error").isNull(), F.col("text"))
        verdicts = cu.with_verdict(answers.select("slot", text.alias("text")), "text", threshold).drop("text")
        judged = Observation()
        state = cu.judge_filter(cases.drop("review", "review_reason"), verdicts, "slot").observe(
            judged, F.count("*").alias("judged"), F.count_if(F.col("judge_state") == "drop").alias("judge_dropped"),
            F.count_if("review").alias("judge_flagged"))
        marked = F.when(F.col("review"), with_review(F.col("case"), dims.JUDGE_UNAVAILABLE)).otherwise(F.col("case"))
        cases = (stored if dedupe is None else scratch.stored)(state.where("judge_state != 'drop'").select(
            "slot", "case_id", marked.alias("case"), "attempts", "review", "review_reason"), "synthesis-judged")
        extras |= judged.get
        scratch.drop(slots)
        count = extras["judged"] - extras["judge_dropped"]
    if dedupe is not None:
        pairs, groups = dd.jaccard_pairs(cases, "slot", F.col("case"), dedupe, first_only=True)
        first = dd.keep_first(cases.select(F.col("slot").alias("id")), pairs, groups)
        left = Observation()
        state = cases.join(first.withColumnRenamed("id", "slot"), "slot").observe(
            left, F.count_if("kept").alias("generated"), F.count_if(~F.col("kept")).alias("deduped_removed"))
        cases = stored(state.where("kept").drop("kept"), "synthesis-cases")
        count, extras["deduped_removed"] = left.get["generated"], left.get["deduped_removed"]
    if judge is None and dedupe is None:
        cases = stored(cases, "synthesis-cases")
    scratch.drop()
    seen = made.get
    row = (spec.name, model, spec.mode, seen["requested"], count, seen["failed"], seen["prompt_tokens"], seen["completion_tokens"],
           *[extras.get(n) for n in ("judged", "judge_dropped", "judge_flagged", "deduped_removed")], seen["stopped"])
    return Run(cases, failures, spark.createDataFrame([row], REPORT))


# --- gap filling -------------------------------------------------------------------------------

@dataclass
class Filled:
    """``cases`` (pack, slot, raw, enriched), ``failures`` (pack, slot, case_id, reason), ``report`` (a row per pack)."""
    cases: DataFrame
    failures: DataFrame
    report: DataFrame


FILL_RULE = ("You receive a case that lacks fields. Return the same case with only those added; "
             "leave every present field as it is.")


def fill_prompts(cases: DataFrame, packs: DataFrame, guide: Callable[[Column], Column]) -> DataFrame:
    """slot, pack, raw, fields, system, user: a completion prompt for each case (pack, slot, raw) with the fields its
    pack lacks. ``packs``: (pack, fields, task_type, primary_industry)."""
    rows = cases.join(packs, "pack")
    system = F.concat(F.lit("You complete evaluation cases. Industry: "), "primary_industry", F.lit(". Task type: "), "task_type",
                      F.lit(".\n" + FILL_RULE + "\n\nFields to add:\n"), guide(F.col("fields")))
    user = F.concat_ws("\n", F.lit("Case (keep every present field unchanged):"), "raw",
                       F.concat(F.lit("Add these fields: "), F.array_join("fields", ", "), F.lit(".")),
                       F.lit("Return the whole case as one JSON object, without prose or fences."))
    return rows.select("pack", "slot", "raw", "fields", system.alias("system"), user.alias("user"))


def fill_gaps(prompts: DataFrame, complete: Completer, fields: list[str], folder: str | None = None) -> Filled:
    """Completes the cases of ``fill_prompts``; a case whose attempts all fail stays as it was. ``fields``: every field
    that can be added; a row adds those of its own list."""
    scratch = Scratch(prompts.sparkSession)
    folder = folder or scratch.folder("gap-fill")
    attempts = attempt_rounds(prompts.select("slot", "system", "user"), complete, folder, label="enrich")
    slots = cu.select_attempts(attempts, ["slot"]).select("slot", "ok", F.to_json("case").alias("completion"), "reason")
    merged = F.when(F.col("ok"), cu.merge_missing(F.col("raw"), F.col("completion"), fields, F.col("fields"))).otherwise(F.col("raw"))
    # the completions grow with the cases, whatever Spark makes of the size of their files: they are never broadcast
    rows = stored(prompts.select("slot", "pack", "raw", "fields").join(slots.hint("merge"), "slot").select(
        "pack", "slot", merged.alias("raw"), F.col("ok").alias("enriched"), "reason", "fields"), "gap-filled")
    scratch.drop()
    failures = rows.where("NOT enriched").select("pack", "slot", F.get_json_object("raw", "$.caseId").alias("case_id"), "reason")
    report = rows.groupBy("pack").agg(F.count("*").alias("input_cases"), F.count_if("enriched").alias("enriched_cases"),
                                      F.count_if(~F.col("enriched")).alias("failed"), F.any_value("fields").alias("fields_targeted"))
    return Filled(rows.select("pack", "slot", "raw", "enriched"), failures, report)
