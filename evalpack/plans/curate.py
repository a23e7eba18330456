"""Curation jobs over the driver tables.

Stand-ins: a generated completion is an ``events`` row wrapped in one of five
shapes chosen by its event type (fenced JSON, JSON in prose, a fenced array,
an object without ``caseId``, plain text); a generation slot is a
conversation whose turns are attempts; a judge verdict is a ``labels`` row
rendered in one of four shapes by (quality, toxic); a task spec is a region
(personas = its customers' market segments); the seed pool is ``benchmark``;
the specs checked for conformance are customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import curate as cu
from ..operators import profile as pf
from ..sources.tables import documents_as_cases, table

BUDGET = 20000
MODEL = "stub-model"
MERGE_FIELDS = ["input", "expected", "k"]


def completion_text() -> F.Column:
    body = F.concat(F.lit('{"caseId": "e'), F.col("event_id").cast("string"), F.lit('", '), F.expr("substr(props, 2)"))
    et = F.col("event_type")
    return (F.when(et == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(et == "click", F.concat(F.lit("Sure, here it is: "), body, F.lit(" thanks")))
            .when(et == "signup", F.concat(F.lit("```\n["), F.format_string("%.2f", F.col("value")), F.lit("]\n```")))
            .when(et == "purchase", F.col("props"))
            .otherwise(F.concat(F.lit("error: "), et)))


def completion_parse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", completion_text().alias("text"))
    p = ev.select("event_id", cu.parse_completion(F.col("text")).alias("p"))
    return p.select("event_id", F.col("p.ok").alias("ok"), F.col("p.reason").alias("reason"),
                    F.col("p.case_id").alias("case_id"))


def _attempts(spark, sf) -> DataFrame:
    conv = table(spark, sf, "conversations")
    text = F.when((F.col("role") == "assistant") & (F.length("text") % 2 == 0),
                  F.format_string('{"caseId": "conv-%d-%d"}', F.col("conv_id"), F.col("turn"))).otherwise(F.col("text"))
    a = conv.select("conv_id", (F.col("turn") + 1).alias("attempt"), text.alias("text"),
                    F.length("text").cast("long").alias("completion_tokens"),
                    F.lit(10).cast("long").alias("prompt_tokens"))
    return a.withColumn("parsed", cu.parse_completion(F.col("text")))


def _slots(spark, sf) -> DataFrame:
    return cu.select_attempts(_attempts(spark, sf), ["conv_id"])


def attempt_select(spark, sf):
    return _slots(spark, sf).select("conv_id", "ok", F.col("attempts").cast("int").alias("attempts"), "case_id",
                                    "reason", "completion_tokens")


def token_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("pack"), F.col("n_chars").alias("tokens"))
    out = cu.token_budget(d, ["pack"], "doc_id", "tokens", BUDGET)
    return out.select("doc_id", "pack", "tokens", F.col("prev_total").cast("long").alias("prev_total"), "kept")


def verdict_text() -> F.Column:
    q, t = F.col("quality"), F.col("toxic")
    return (F.when((q == 1) & (t == 0), F.lit('{"pass": true, "score": 1.7, "reason": "clear"}'))
            .when((q == 0) & (t == 0), F.format_string('{"score": %.2f}', (F.col("doc_id") % 100) / 100.0))
            .when((q == 1) & (t == 1), F.lit('```json\n{"pass": false}\n```'))
            .otherwise(F.lit("judge timed out")))


def _verdicts(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", cu.interpret_verdict(verdict_text()).alias("verdict"))


def judge_interpret(spark, sf):
    v = _verdicts(spark, sf)
    return v.select("doc_id", F.col("verdict").isNotNull().alias("has_verdict"), F.col("verdict.pass").alias("pass"),
                    F.col("verdict.score").alias("score"), F.col("verdict.reason").alias("reason"))


def _judged(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return cu.judge_filter(docs, _verdicts(spark, sf), "doc_id")


def judge_filter(spark, sf):
    return _judged(spark, sf).filter(F.col("judge_state") != "drop").select("doc_id", "review", "review_reason")


def judge_counters(spark, sf):
    j = _judged(spark, sf)
    return j.agg(F.count(F.lit(1)).alias("judged"),
                 F.count(F.when(F.col("judge_state") == "drop", 1)).alias("dropped"),
                 F.count(F.when(F.col("judge_state") == "flagged", 1)).alias("flagged"))


def provenance_stamp(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props", "event_type")
    stamped = cu.stamp_provenance(F.col("props"), F.lit(MODEL), F.col("event_type"))
    s = ev.select("event_id", stamped.alias("m"))
    return s.select("event_id", F.get_json_object("m", "$.k").cast("long").alias("k"),
                    F.get_json_object("m", "$.provenance").alias("provenance"),
                    F.get_json_object("m", "$.generator.engine").alias("engine"),
                    F.get_json_object("m", "$.generator.model").alias("model"),
                    F.get_json_object("m", "$.generator.specName").alias("spec_name"),
                    F.array_join(F.json_object_keys("m"), ",").alias("keys"))


BAD_ANSWER = "error: no answer"


def _landed_drafts(spark, sf) -> DataFrame:
    """Stand-in completions of a synthesis run: slot = document. One document in eleven is never answered in JSON;
    else one attempt of three is an array, and the others hold the document's text as a case."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("n_chars").cast("long").alias("n_chars"),
                                             F.explode(F.array(*map(F.lit, range(1, dims.MAX_ATTEMPTS + 1)))).alias("attempt"))
    case = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("caseId"), F.lit("custom").alias("taskType"),
                              F.col("text").alias("input"), F.struct("lang").alias("metadata")))
    text = (F.when(F.col("doc_id") % 11 == 5, BAD_ANSWER).when((F.col("doc_id") + F.col("attempt")) % 3 == 0, "[1]")
            .otherwise(F.concat(F.lit("```json\n"), case, F.lit("\n```"))))
    return d.select(F.col("doc_id").alias("slot"), "attempt", text.alias("text"), F.lit(10).cast("long").alias("prompt_tokens"),
                    F.col("n_chars").alias("completion_tokens"))


def _synthesis(spark, sf):
    """A run over all documents: a slot each, nine tenths of the tokens asked for as the budget, labels as verdicts,
    dedupe at the stock similarity."""
    from ..operators import synthesis as sy
    docs = table(spark, sf, "documents")
    asked = docs.agg(F.coalesce(F.sum(F.col("n_chars").cast("long")), F.lit(0))).first()[0]
    prompts = docs.select(F.col("doc_id").alias("slot"), F.lit("Write a case.").alias("system"),
                          F.format_string("Case %d.", F.col("doc_id")).alias("user"))
    verdicts = table(spark, sf, "labels").select(F.col("doc_id").alias("slot"), F.lit(1).alias("attempt"), verdict_text().alias("text"),
                                                 F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))
    return sy.synthesize(prompts, sy.Spec(SPEC_NAME, mode="seeded"), MODEL, sy.landed(_landed_drafts(spark, sf)), judge=sy.landed(verdicts),
                         dedupe=dims.DEDUPE_JACCARD_THRESHOLD, max_tokens=asked * 9 // 10)


SPEC_NAME = "documents"


def synthesis_report(spark, sf):
    """The report of a synthesis run, from counters observed while its tables were made."""
    return _synthesis(spark, sf).report


def synthesis_failures(spark, sf):
    """Every slot that failed within the budget, with the reason of its last attempt."""
    return _synthesis(spark, sf).failures.select(F.col("slot").alias("doc_id"), "reason")


def synthesis_cases(spark, sf):
    """The cases of a synthesis run, with their provenance and review marks read back from the case."""
    c = _synthesis(spark, sf).cases
    return c.select(F.col("slot").alias("doc_id"), "case_id", F.col("attempts").cast("int").alias("attempts"),
                    F.get_json_object("case", "$.metadata.lang").alias("lang"), F.get_json_object("case", "$.metadata.provenance").alias("provenance"),
                    F.get_json_object("case", "$.metadata.generator.specName").alias("spec_name"),
                    (F.coalesce(F.get_json_object("case", "$.metadata.review"), F.lit("false")) == "true").alias("review"),
                    F.get_json_object("case", "$.metadata.reviewReason").alias("review_reason"),
                    F.sha2(F.get_json_object("case", "$.input"), 256).alias("input_sha256"))


def fold_rows(*frames: DataFrame) -> DataFrame:
    """Combine single-row frames with disjoint columns into one row by
    stacking them and taking the first non-null value of every column."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def gap_fields(spark, sf):
    p = pf.profile(documents_as_cases(spark, sf))
    return p.select("pack", F.array_join(cu.gap_fields(F.col("missing")), ",").alias("fields"))


def _completion_for_merge() -> F.Column:
    return F.when(F.col("event_type").isin("view", "click"), F.format_string(
        '{"caseId": "e%d", "k": -1, "input": "%s", "expected": {"v": %.2f}}',
        F.col("event_id"), F.col("event_type"), F.col("value")))


def _merged(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    c = ev.withColumn("completion", _completion_for_merge())
    ok = cu.parse_completion(F.col("completion"))
    merged = F.when(ok["ok"], cu.merge_missing(F.col("props"), F.col("completion"), MERGE_FIELDS)).otherwise(F.col("props"))
    return c.select("event_id", ok["ok"].alias("enriched"), merged.alias("merged"))


def merge_completion(spark, sf):
    m = _merged(spark, sf)
    return m.select("event_id", F.array_join(F.array_sort(F.json_object_keys("merged")), ",").alias("keys"),
                    F.get_json_object("merged", "$.k").cast("long").alias("k"),
                    F.get_json_object("merged", "$.input").alias("input"),
                    F.get_json_object("merged", "$.expected.v").cast("double").alias("expected_v"))


def _fill_prompts(spark, sf) -> DataFrame:
    """A gap-fill prompt for each JSON case, with the fields that its pack's profile lacks."""
    from ..operators import industry as ind
    from ..operators import synthesis as sy
    from .inventory import json_cases
    from .packs import TAXONOMY
    cases = json_cases(spark, sf).select("pack", "seq", "raw")
    scores = ind.industry_scores(ind.keyword_matches(cases, TAXONOMY), TAXONOMY)
    prim = ind.industry_top(scores, cases, TAXONOMY).where("rank = 1").select("pack", F.col("slug").alias("primary_industry"))
    # a row a pack, read by each round of attempts
    packs = sy.stored(pf.profile(cases).select("pack", cu.gap_fields(F.col("missing")).alias("fields"), "task_type").join(prim, "pack"), "packs")
    return sy.fill_prompts(cases.withColumnRenamed("seq", "slot"), packs, _guide)


def _landed_fills(spark, sf) -> DataFrame:
    """Stand-in completions of gap filling: every field filled; one document in seven is only answered by its third
    attempt, one in thirteen never."""
    targets = sorted({f for _k, f in dims.SIGNAL_TO_FIELD})
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(1, dims.MAX_ATTEMPTS + 1)))).alias("attempt"))
    case = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("caseId"),
                              *[F.lit(f"filled {f}").alias(f) for f in targets]))
    text = (F.when(F.col("doc_id") % 13 == 1, F.lit('{"note": "no id"}')).when((F.col("doc_id") % 7 == 2) & (F.col("attempt") < 3), "not yet")
            .otherwise(case))
    return d.select(F.col("doc_id").alias("slot"), "attempt", text.alias("text"), F.lit(1).cast("long").alias("prompt_tokens"),
                    F.lit(1).cast("long").alias("completion_tokens"))


def _fill(spark, sf):
    from ..operators import synthesis as sy
    return sy.fill_gaps(_fill_prompts(spark, sf), sy.landed(_landed_fills(spark, sf)), sorted({f for _k, f in dims.SIGNAL_TO_FIELD}))


def enrichment_report(spark, sf):
    """Per pack: cases read, filled and failed, and the fields its profile lacks."""
    return _fill(spark, sf).report.select("pack", "input_cases", "enriched_cases", "failed",
                                          F.array_join("fields_targeted", ",").alias("fields_targeted"))


def enrichment_failures(spark, sf):
    """Every case that could not be filled, with the reason of its last attempt."""
    return _fill(spark, sf).failures.select("pack", F.col("slot").alias("doc_id"), "case_id", "reason")


def enrichment_cases(spark, sf):
    """The filled cases: which fields each has now."""
    c = _fill(spark, sf).cases
    return c.select(F.col("slot").alias("doc_id"), "enriched", F.array_join(F.array_sort(F.json_object_keys("raw")), ",").alias("keys"))


# ---------------------------------------------------------------------------
# Prompt tables
# ---------------------------------------------------------------------------
# Our own prompt wording; only the structure follows the reference
# (examples, case i of n, persona rotation, field guide, output contract).
FIELD_GUIDE = {
    "input": "input: the task input the agent receives, with concrete identifiers.",
    "expected": "expected: the gold answer as a structured object.",
    "context": "context: list of background strings the answer must rely on.",
    "rubric": "rubric: explicit pass and fail criteria.",
    "checker": "checker: a deterministic check specification.",
    "trace": "trace: allowed tools and their expected order.",
    "environment": "environment: the fixture state the agent reads.",
    "messages": "messages: a multi-turn list of role/content turns.",
    "metadata": "metadata: domain, workflow, split, difficulty, license.",
}


def _guide(fields) -> F.Column:
    m = F.create_map(*[x for k, v in FIELD_GUIDE.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(fields, lambda f: F.concat(F.lit("- "), F.coalesce(
        F.element_at(m, f), F.concat(f, F.lit(": custom field, fill it meaningfully."))))), "\n")


def specs(spark, sf) -> DataFrame:
    """One task spec per region; personas are its customers' segments
    (a set bounded by the number of segments)."""
    reg = table(spark, sf, "region")
    nat = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    cus = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    personas = (cus.join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
                .groupBy("n_regionkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("personas")))
    counts = nat.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("count"))
    return (reg.join(personas, F.col("r_regionkey") == F.col("n_regionkey"), "left").drop("n_regionkey")
            .join(counts, F.col("r_regionkey") == F.col("n_regionkey"), "left")
            .select(F.col("r_name").alias("spec"), F.lower("r_name").alias("industry"), F.lit("tool_use").alias("task_type"),
                    F.coalesce("count", F.lit(dims.SPEC_DEFAULT_COUNT)).cast("int").alias("count"),
                    F.when(F.col("r_regionkey") % 2 == 0, "seeded").otherwise("from-scratch").alias("mode"),
                    F.coalesce("personas", F.array().cast("array<string>")).alias("personas"),
                    F.when(F.length("r_name") > 4, F.array(F.concat(F.lit("Set the scene in "), F.initcap("r_name"), F.lit(".")),
                                                           F.lit("Use no real names.")))
                    .otherwise(F.array().cast("array<string>")).alias("constraints"),
                    F.array(*[F.lit(f) for f in dims.SPEC_DEFAULT_FIELDS]).alias("fields")))


def _prompts(spark, sf) -> DataFrame:
    sp = specs(spark, sf)
    # the first three seeds, attached as a scalar subquery (one row, bounded)
    seeds = (table(spark, sf, "benchmark").select("item_id", "text").orderBy("item_id").limit(dims.SEED_EXAMPLES)
             .agg(F.array_sort(F.collect_list(F.struct("item_id", F.to_json(F.struct("item_id", "text")).alias("j"))))
                  .alias("ex")))
    j = sp.withColumn("ex", seeds.select("ex").scalar())
    rows = j.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("idx"))
    seeded = (F.col("mode") == "seeded") & (F.size(F.coalesce("ex", F.array())) > 0)
    rules = F.concat(F.lit("Constraints:\n"), F.array_join(F.transform("constraints", lambda c: F.concat(F.lit("- "), c)), "\n"))
    system = F.concat_ws("\n\n", F.concat(F.lit("You generate synthetic cases for agent evaluation.\nIndustry: "), F.col("industry"),
                                          F.lit(". Task type: "), F.col("task_type"), F.lit(".")),
                         F.when(F.size("constraints") > 0, rules), F.concat(F.lit("Fields:\n"), _guide(F.col("fields"))))
    case_line = F.format_string("Case %d of %d: vary identifiers and difficulty.", F.col("idx") + 1, F.col("count"))
    mark = F.lit('Set metadata.provenance to "synthetic".')
    contract = F.concat(F.lit("Return one JSON object with keys: "),
                        F.array_join(F.concat(F.array(F.lit("caseId"), F.lit("taskType")), F.col("fields")), ", "),
                        F.lit(". taskType must be "), F.col("task_type"), F.lit("."))
    examples = F.array_join(F.transform(F.coalesce("ex", F.array()), lambda e, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e["j"])), "\n\n")
    k = F.size("personas")
    persona = F.when(k > 0, F.element_at("personas", (F.col("idx") % k + 1).cast("int")))
    user_seeded = F.concat_ws("\n\n", F.format_string("Write one new case unlike these %d examples.",
                                                      F.size(F.coalesce("ex", F.array()))), examples, case_line, contract, mark)
    user_scratch = F.concat_ws("\n\n", F.concat(F.lit("Write one new case for the "), F.col("industry"), F.lit(" domain.")),
                               F.when(persona.isNotNull(), F.concat(F.lit("Persona: "), persona, F.lit("."))),
                               case_line, contract, mark)
    return rows.select("spec", F.col("idx").cast("int").alias("idx"),
                       F.when(seeded, "seeded").otherwise("from-scratch").alias("prompt_mode"),
                       persona.alias("persona"), system.alias("system_prompt"),
                       F.when(seeded, user_seeded).otherwise(user_scratch).alias("user_prompt"))


def prompts_seeded(spark, sf):
    return _prompts(spark, sf).filter(F.col("prompt_mode") == "seeded").drop("persona")


def prompts_persona(spark, sf):
    return _prompts(spark, sf).filter(F.col("prompt_mode") == "from-scratch")


def prompts_gap_fill(spark, sf):
    """Per case: a completion prompt naming the pack's gap fields and embedding the case JSON."""
    p = _fill_prompts(spark, sf)
    return p.select(F.col("slot").alias("doc_id"), "pack", F.array_join("fields", ",").alias("fields"), F.col("system").alias("system_prompt"),
                    F.sha2(F.get_json_object("raw", "$.input"), 256).alias("input_sha256"),
                    F.replace(F.col("user"), F.col("raw"), F.lit("<case>")).alias("user_prompt"))


def prompts_judge(spark, sf):
    """Per document drafted as a case: the judge's prompt."""
    from ..operators import synthesis as sy
    drafts = sy.stored(cu.with_parsed(_landed_drafts(spark, sf).where("attempt = 1")), "drafts").where("parsed.ok")
    cases = drafts.select("slot", F.to_json("parsed.case").alias("case"))
    p = sy.judge_prompts(cases, "finance", "custom", dims.JUDGE_PASS_THRESHOLD).join(cases, "slot")
    return p.select(F.col("slot").alias("doc_id"), F.col("system").alias("system_prompt"),
                    F.replace(F.col("user"), F.col("case"), F.lit("<case>")).alias("user_prompt"))


def spec_violations(spark, sf):
    """Spec conformance rules applied to one spec per customer."""
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    industry = (F.when(seg == "AUTOMOBILE", "logistics").when(seg == "BUILDING", "manufacturing")
                .when(seg == "FURNITURE", "ecommerce").otherwise(F.lower(seg)))
    ttypes = F.array(*[F.lit(t) for t in dims.TASK_TYPES])
    task = F.when(F.col("c_nationkey") < len(dims.TASK_TYPES),
                  F.element_at(ttypes, (F.col("c_nationkey") + 1).cast("int"))).otherwise(F.lit("free_form"))
    count = F.when(F.col("c_acctbal") > -500, (F.col("c_acctbal") / 1000).cast("int"))
    mode = F.when(F.col("c_acctbal") > 5000, "seeded").when(F.col("c_acctbal") > 0, "from-scratch")
    seeds = F.when(F.col("c_acctbal") > 8000, F.lit("seeds.jsonl"))
    s = c.select("c_custkey", F.col("c_name").alias("name"), industry.alias("industry"), task.alias("task_type"),
                 F.coalesce(count, F.lit(dims.SPEC_DEFAULT_COUNT)).alias("count"),
                 F.coalesce(mode, F.lit(dims.SPEC_DEFAULT_MODE)).alias("mode"), seeds.alias("seeds"))
    slugs = F.array(*[F.lit(t[0]) for t in dims.STOCK_TAXONOMY])
    v = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("name: required")),
        F.when(~F.array_contains(slugs, F.col("industry")), F.lit("industry: not in taxonomy")),
        F.when(~F.array_contains(ttypes, F.col("task_type")), F.lit("taskType: unknown")),
        F.when(F.col("count") <= 0, F.lit("count: must be a positive integer")),
        F.when(~F.col("mode").isin(*dims.SPEC_MODES), F.lit("mode: unknown")),
        F.when((F.col("mode") == "seeded") & F.col("seeds").isNull(), F.lit("seedCases: required when seeded")),
    ))
    return s.select("c_custkey", "industry", "task_type", "count", "mode", F.array_join(v, "; ").alias("violations"))


def closed_loop_lift(spark, sf):
    """Profile the packs, fill every pack's gap fields from a completion that
    carries all target fields (never overwriting), profile again and report
    the completeness lift per pack."""
    from .inventory import json_cases
    cases = json_cases(spark, sf).select("pack", "seq", "raw")
    before = pf.profile(cases).select("pack", F.col("completeness").alias("before"),
                                      cu.gap_fields(F.col("missing")).alias("fields"))
    targets = sorted({f for _k, f in dims.SIGNAL_TO_FIELD})
    completion = F.to_json(F.struct(F.concat(F.lit("fill-"), F.col("seq").cast("string")).alias("caseId"),
                                    *[F.lit(f"filled {f}").alias(f) for f in targets]))
    filled = (cases.join(before.select("pack", "fields"), "pack")
              .select("pack", "seq", cu.merge_missing(F.col("raw"), completion, targets, F.col("fields")).alias("raw")))
    after = pf.profile(filled).select("pack", F.col("completeness").alias("after"))
    return before.join(after, "pack").select(
        "pack", F.array_join("fields", ",").alias("fields"), F.col("before").cast("double").alias("before"),
        F.col("after").cast("double").alias("after"), (F.col("after") - F.col("before")).cast("double").alias("lift"))
