"""Synthesis and curation as batch jobs around an injected model call.

The model call itself is the only Python boundary (``batch_inference``,
``mapInPandas`` with a caller-supplied function); parsing completions,
choosing attempts, token budgets, judge verdicts, provenance and merges are
column expressions, joins and aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

# ---------------------------------------------------------------------------
# Completion parsing (Y3)
# ---------------------------------------------------------------------------
FENCE = "```"


def ws_trim(text: Column) -> Column:
    """Strip leading and trailing whitespace (not only blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fence_parts(text: Column) -> Column:
    """What stands before, in and behind the first fenced block: three parts, or fewer if none is closed. A text is
    searched for the fences alone, as a pattern of the whole block steps through long bodies a letter at a time."""
    return F.split(text, FENCE, 3)


def fenced_body(parts: Column) -> Column:
    """The trimmed body of a closed block, without the word ``json`` behind its opening fence."""
    body = parts[1]
    return ws_trim(F.when(F.lower(F.substring(body, 1, 4)) == "json", F.substr(body, F.lit(5))).otherwise(body))


def extract_json_object(text: Column) -> Column:
    """Trim; take the first fenced block's body if any; then cut from the
    first ``{`` to the last ``}`` when both exist in that order."""
    t = ws_trim(text)
    parts = fence_parts(t)
    v = F.when(F.size(parts) == 3, fenced_body(parts)).otherwise(t)
    first = F.instr(v, "{")
    last = F.length(v) - F.instr(F.reverse(v), "}") + 1
    ok = (first > 0) & (F.instr(F.reverse(v), "}") > 0) & (last > first)
    return F.when(ok, F.substring(v, first, last - first + 1)).otherwise(v)


def parse_completion(text: Column) -> Column:
    """struct<ok boolean, reason string, case variant, case_id string>."""
    body = extract_json_object(text)
    v = F.try_parse_json(body)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    cid = F.try_variant_get(v, "$.caseId", "variant")
    cid_ok = (F.coalesce(F.schema_of_variant(cid) == "STRING", F.lit(False))
              & (F.coalesce(F.trim(F.variant_get(cid, "$", "string")), F.lit("")) != ""))
    reason = (F.when(v.isNull(), F.lit(dims.PARSE_JSON_FAILED))
              .when(~is_obj, F.lit(dims.PARSE_NOT_OBJECT))
              .when(~cid_ok, F.lit(dims.PARSE_MISSING_CASE_ID)))
    ok = reason.isNull()
    return F.struct(ok.alias("ok"), reason.alias("reason"), F.when(ok, v).alias("case"),
                    F.when(ok, F.variant_get(cid, "$", "string")).alias("case_id"))


def _with_body(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``_body``, what ``extract_json_object`` cuts out. Each step is a column of its own, so that
    none is computed twice or grows the generated code; the same holds for ``with_parsed`` and ``with_verdict``."""
    rows = rows.withColumn("_t", ws_trim(F.col(text)))
    rows = rows.withColumn("_parts", fence_parts(F.col("_t")))
    rows = rows.withColumn("_t", F.when(F.size("_parts") == 3, fenced_body(F.col("_parts"))).otherwise(F.col("_t")))
    rows = rows.withColumns({"_first": F.instr("_t", "{"), "_back": F.instr(F.reverse("_t"), "}")})
    rows = rows.withColumn("_last", F.length("_t") - F.col("_back") + 1)
    cut = (F.col("_first") > 0) & (F.col("_back") > 0) & (F.col("_last") > F.col("_first"))
    return rows.withColumn("_body", F.when(cut, F.substring(F.col("_t"), F.col("_first"), F.col("_last") - F.col("_first") + 1))
                           .otherwise(F.col("_t")))


def with_parsed(rows: DataFrame, text: str = "text", error: str | None = None) -> DataFrame:
    """``rows`` with ``parsed``, as ``parse_completion`` makes it; a row with an ``error`` fails with that reason."""
    names = rows.columns
    rows = _with_body(rows, text).withColumn("_v", F.try_parse_json("_body"))
    rows = rows.withColumns({"_kind": F.schema_of_variant("_v"), "_cid": F.try_variant_get("_v", "$.caseId", "variant")})
    rows = rows.withColumns({"_cid_kind": F.schema_of_variant("_cid"), "_id": F.try_variant_get("_v", "$.caseId", "string")})
    is_obj = F.coalesce(F.col("_kind").startswith("OBJECT"), F.lit(False))
    has_id = F.coalesce((F.col("_cid_kind") == "STRING") & (F.trim("_id") != ""), F.lit(False))
    reason = (F.when(F.col("_v").isNull(), dims.PARSE_JSON_FAILED).when(~is_obj, dims.PARSE_NOT_OBJECT)
              .when(~has_id, dims.PARSE_MISSING_CASE_ID))
    rows = rows.withColumn("_reason", reason if error is None else F.coalesce(error, reason))
    ok = F.col("_reason").isNull()
    return rows.select(*names, F.struct(ok.alias("ok"), F.col("_reason").alias("reason"), F.when(ok, F.col("_v")).alias("case"),
                                        F.when(ok, F.col("_id")).alias("case_id")).alias("parsed"))


def with_verdict(rows: DataFrame, text: str = "text", threshold: float = dims.JUDGE_PASS_THRESHOLD) -> DataFrame:
    """``rows`` with ``verdict``, as ``interpret_verdict`` makes it."""
    names = rows.columns
    rows = _with_body(rows, text).withColumn("_v", F.try_parse_json("_body")).withColumn("_kind", F.schema_of_variant("_v"))
    rows = rows.withColumns({f"_{n}": F.try_variant_get("_v", f"$.{n}", "variant") for n in ("score", "pass", "reason")})
    rows = rows.withColumns({f"_{n}_kind": F.schema_of_variant(f"_{n}") for n in ("score", "pass", "reason")})
    number = F.coalesce(F.col("_score_kind").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    rows = rows.withColumn("_p", F.when(F.col("_pass_kind") == "BOOLEAN", F.try_variant_get("_v", "$.pass", "boolean")))
    rows = rows.withColumn("_s", F.when(number, F.least(F.greatest(F.try_variant_get("_v", "$.score", "double"), F.lit(0.0)), F.lit(1.0)))
                           .otherwise(F.when(F.coalesce("_p", F.lit(False)), 1.0).otherwise(0.0)))
    why = F.when(F.col("_reason_kind") == "STRING", F.try_variant_get("_v", "$.reason", "string")).otherwise("")
    is_obj = F.coalesce(F.col("_kind").startswith("OBJECT"), F.lit(False))
    return rows.select(*names, F.when(is_obj, F.struct(F.coalesce("_p", F.col("_s") >= threshold).alias("pass"), F.col("_s").alias("score"),
                                                       why.alias("reason"))).alias("verdict"))


def select_attempts(attempts: DataFrame, slot_keys: list[str], attempt_col: str = "attempt") -> DataFrame:
    """Per slot: the first parsable attempt, of all that landed, wins (its case and tokens);
    otherwise the slot fails with the last attempt's reason. ``attempts``
    carries ``parsed`` (from ``parse_completion``) and token columns
    ``prompt_tokens``, ``completion_tokens``. One aggregate per slot."""
    ok_order = F.when(F.col("parsed.ok"), F.col(attempt_col))
    return attempts.groupBy(*slot_keys).agg(
        F.min(ok_order).alias("winning_attempt"),
        F.max(attempt_col).alias("attempts_made"),
        F.min_by(F.struct(F.col("parsed.case_id").alias("case_id"), F.col("parsed.case").alias("case"),
                          "prompt_tokens", "completion_tokens"), ok_order).alias("win"),
        F.max_by(F.col("parsed.reason"), F.col(attempt_col)).alias("last_reason"),
    ).select(*slot_keys, F.col("winning_attempt").isNotNull().alias("ok"),
             F.coalesce("winning_attempt", "attempts_made").alias("attempts"),
             F.col("win.case_id").alias("case_id"), F.col("win.case").alias("case"),
             F.col("win.prompt_tokens").alias("prompt_tokens"), F.col("win.completion_tokens").alias("completion_tokens"),
             F.when(F.col("winning_attempt").isNull(), F.col("last_reason")).alias("reason"))


# ---------------------------------------------------------------------------
# Token budget (Y4): two-level prefix sum
# ---------------------------------------------------------------------------
def token_budget(rows: DataFrame, keys: list[str], seq: str, tokens: str, max_tokens: int,
                 bucket_width: int = 1 << 16) -> DataFrame:
    """Adds ``prev_total`` (tokens of earlier rows of the same key) and
    ``kept``: rows are kept while the running total before them is below
    ``max_tokens``, so the row that reaches the budget is kept and the first
    row survives even a budget of 0.

    The running sum is computed in two levels so no window spans a whole
    key: bucket totals (``seq // bucket_width``) are a map-side combined
    aggregate, their prefix over buckets is a window over the small bucket
    table, and the within-bucket prefix is a window over one bucket."""
    r = rows.withColumn("_b", F.floor(F.col(seq) / bucket_width))
    tot = r.groupBy(*keys, "_b").agg(F.sum(tokens).alias("_bt"), F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = (tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wb), F.lit(0)))
           .withColumn("_offn", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bt", "_bn"))
    wi = Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    within = (r.withColumn("_in", F.coalesce(F.sum(tokens).over(wi), F.lit(0)))
              .withColumn("_inn", F.count(F.lit(1)).over(wi)))
    out = (within.join(off, [*keys, "_b"])
           .withColumn("prev_total", F.col("_off") + F.col("_in"))
           .withColumn("prev_rows", F.col("_offn") + F.col("_inn")))
    kept = (F.col("prev_rows") == 0) | (F.col("prev_total") < max_tokens)
    return out.withColumn("kept", kept).drop("_b", "_off", "_in", "_offn", "_inn", "prev_rows")


# ---------------------------------------------------------------------------
# Judge (Y5, Y5b)
# ---------------------------------------------------------------------------
def interpret_verdict(text: Column, threshold: float = dims.JUDGE_PASS_THRESHOLD) -> Column:
    """struct<pass, score, reason>, or NULL when the text has no JSON object.
    score = clamp01(number) if numeric else (pass is true ? 1 : 0);
    pass = the boolean if given else score >= threshold; reason default ''."""
    v = F.try_parse_json(extract_json_object(text))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    s = F.try_variant_get(v, "$.score", "variant")
    p = F.try_variant_get(v, "$.pass", "variant")
    r = F.try_variant_get(v, "$.reason", "variant")
    s_num = F.coalesce(F.schema_of_variant(s).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    p_bool = F.coalesce(F.schema_of_variant(p) == "BOOLEAN", F.lit(False))
    p_val = F.when(p_bool, F.variant_get(p, "$", "boolean"))
    score = F.when(s_num, F.least(F.greatest(F.variant_get(s, "$", "double"), F.lit(0.0)), F.lit(1.0))) \
        .otherwise(F.when(F.coalesce(p_val, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)))
    passed = F.when(p_bool, p_val).otherwise(score >= threshold)
    reason = F.when(F.coalesce(F.schema_of_variant(r) == "STRING", F.lit(False)), F.variant_get(r, "$", "string")) \
        .otherwise(F.lit(""))
    return F.when(is_obj, F.struct(passed.alias("pass"), score.alias("score"), reason.alias("reason")))


def judge_filter(cases: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Fail-open filter: a case with no verdict is kept and flagged for
    review; a failing verdict drops the case. ``verdicts``: ``(key, verdict
    struct or NULL)``. Adds ``review`` and ``review_reason``; keeps
    ``judge_state`` in {pass, drop, flagged} for the counters."""
    j = cases.join(verdicts, key, "left")
    state = (F.when(F.col("verdict").isNull(), F.lit("flagged"))
             .when(F.col("verdict.pass"), F.lit("pass")).otherwise(F.lit("drop")))
    return (j.withColumn("judge_state", state)
            .withColumn("review", F.col("judge_state") == "flagged")
            .withColumn("review_reason", F.when(F.col("review"), F.lit("judge-unavailable"))))


# ---------------------------------------------------------------------------
# Provenance, gap fields, merge (Y6, Y8, Y9)
# ---------------------------------------------------------------------------
def stamp_provenance(metadata_json: Column, model: Column, spec_name: Column,
                     engine: str = dims.ENGINE_LABEL) -> Column:
    """Metadata object with ``provenance='synthetic'`` and ``generator``
    overwritten in place (last value, first position), other keys and
    their JSON values kept (JSON text in, JSON text out)."""
    meta = F.coalesce(F.from_json(metadata_json, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    gen = F.parse_json(F.to_json(F.struct(F.lit(engine).alias("engine"), model.alias("model"),
                                          spec_name.alias("specName"))))
    stamped = F.map_concat(meta, F.create_map(F.lit("provenance"), F.parse_json(F.lit('"synthetic"')),
                                              F.lit("generator"), gen))
    return F.to_json(stamped)


def gap_fields(missing: Column) -> Column:
    """Missing signals -> distinct target fields in signal order."""
    mapping = F.create_map(*[x for k, f in dims.SIGNAL_TO_FIELD for x in (F.lit(k), F.lit(f))])
    return F.array_distinct(F.array_compact(F.transform(missing, lambda s: F.element_at(mapping, s))))


def _quoted(field: str) -> str:
    """A field name as it stands in a variant path, in the quotes it does not hold."""
    return f'"{field}"' if "'" in field else f"'{field}'"


def merge_missing(original: Column, completion: Column, fields: list[str],
                  allowed: Column | None = None) -> Column:
    """JSON object text: the original plus each listed field that is absent
    from the original (a JSON null counts as present) and present in the
    completion. Never overwrites; other completion keys are ignored. An
    original that is not a JSON object is returned unchanged.
    ``allowed`` (array<string>) narrows the fields per row."""
    c = F.try_parse_json(completion)
    okeys = F.coalesce(F.json_object_keys(original), F.array().cast("array<string>"))
    ckeys = F.coalesce(F.json_object_keys(completion), F.array().cast("array<string>"))
    frags = F.array_compact(F.array(*[
        F.when(~F.array_contains(okeys, f) & F.array_contains(ckeys, f)
               & (F.array_contains(allowed, f) if allowed is not None else F.lit(True)),
               F.concat(F.lit(json.dumps(f) + ":"), F.to_json(F.try_variant_get(c, f"$[{_quoted(f)}]", "variant"))))
        for f in fields]))
    body = F.regexp_replace(F.trim(original), r"\}\s*$", "")
    sep = F.when(body.rlike(r"\{\s*$"), F.lit("")).otherwise(F.lit(","))
    return F.when((F.size(frags) == 0) | F.json_object_keys(original).isNull(), original).otherwise(
        F.concat(body, sep, F.array_join(frags, ","), F.lit("}")))


# ---------------------------------------------------------------------------
# Batch inference (Y2): the one Python boundary
# ---------------------------------------------------------------------------
def batch_inference(prompts: DataFrame, generate: Callable[[pd.DataFrame], pd.DataFrame],
                    out_schema: str, partitions: int | None = None) -> DataFrame:
    """Send prompt rows to a caller-supplied ``generate(pdf) -> pdf`` in Arrow
    batches. ``partitions`` bounds the concurrency against the model
    endpoint."""
    df = prompts.repartition(partitions) if partitions else prompts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield generate(pdf)

    return df.mapInPandas(run, out_schema)
