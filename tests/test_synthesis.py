"""Runs of synthesis and gap filling: rounds that resume, counters, review marks, failures; signal evidence."""

import glob
import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalpack import dims
from evalpack.operators import curate as cu
from evalpack.operators import profile as pf
from evalpack.operators import synthesis as sy

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def client(calls, answer, broken=False):
    """A model that notes each call in a file of its own below ``calls``."""
    def call(system, user, label):
        with open(os.path.join(calls, f"{label}.{uuid.uuid4().hex}"), "w"):
            pass
        if broken and label.endswith("-2"):
            os._exit(1)  # the worker dies, as with a killed run
        return answer(user, label)
    return sy.model_client(call, partitions=2)


def sent(calls):
    return sorted(os.path.basename(f).rsplit(".", 1)[0] for f in glob.glob(f"{calls}/*"))


def prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("slot"), F.lit("s").alias("system"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("user"))


def answer(user, label):
    slot, attempt = int(user[1:]), int(label.rsplit("-", 1)[1])
    if slot == 3:
        raise ValueError("no model")
    if attempt <= slot % 3 or slot == 5:
        return "not json", 1, 1
    return f'Here: {{"caseId": "c{slot}", "input": "alpha beta {slot}"}}', 10, slot


def test_rounds_send_only_what_failed_and_resume(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    folder = str(tmp_path / "table")
    p = prompts(spark, 9)
    # killed while the second round runs
    with pytest.raises(Exception):
        sy.attempt_rounds(p, client(calls, answer, broken=True), folder).collect()
    first = [f"case-{i}-1" for i in range(9)]
    assert [c for c in sent(calls) if c.endswith("-1")] == first
    for f in glob.glob(f"{calls}/*-2.*"):
        os.rename(f, f + ".cut")
    attempts = sy.attempt_rounds(p, client(calls, answer), folder)
    again = [c for c in sent(calls) if not c.count(".")]
    # the first round is read, not sent; the second and third hold only open slots, each sent once
    assert [c for c in again if c.endswith("-1")] == first
    assert [c for c in again if c.endswith("-2")] == ["case-1-2", "case-2-2", "case-3-2", "case-4-2", "case-5-2", "case-7-2", "case-8-2"]
    assert [c for c in again if c.endswith("-3")] == ["case-2-3", "case-3-3", "case-5-3", "case-8-3"]
    got = {r.slot: r for r in cu.select_attempts(attempts, ["slot"]).collect()}
    assert {s: (r.ok, r.attempts) for s, r in got.items()} == {
        0: (True, 1), 1: (True, 2), 2: (True, 3), 3: (False, 3), 4: (True, 2), 5: (False, 3), 6: (True, 1), 7: (True, 2), 8: (True, 3)}
    assert got[3].reason == "call_failed: no model" and got[5].reason == dims.PARSE_JSON_FAILED
    # a finished table is only read
    n = len(sent(calls))
    assert sy.attempt_rounds(p, client(calls, answer), folder).count() == attempts.count() and len(sent(calls)) == n


def test_run_report_and_marks(spark, tmp_path):
    calls = str(tmp_path)
    verdicts = spark.createDataFrame([(0, 1, '{"pass": true}'), (1, 1, '{"score": 0.1}'), (4, 1, "late"), (6, 1, '{"score": 0.9}')],
                                     "slot long, attempt int, text string").withColumns(
        {c: F.lit(None).cast("long") for c in ("prompt_tokens", "completion_tokens")})
    made = sy.synthesize(prompts(spark, 9), sy.Spec("demo", mode="seeded"), "m1", client(calls, answer), judge=sy.landed(verdicts),
                         dedupe=0.8, max_tokens=66)
    r = made.report.first().asDict()
    # tokens: 10, 11, 12, 0, 14, 0, 16 -> 63 before slot 7, which passes 66; slot 8 is neither made nor failed.
    # 1 is dropped; 2, 4 and 7 are marked, and of their 21 tokens each pair shares 19 (19 of 23), so 2 alone stays
    assert r == dict(spec_name="demo", model="m1", mode="seeded", requested=9, generated=3, failed=2, prompt_tokens=60, completion_tokens=20,
                     judged=6, judge_dropped=1, judge_flagged=3, deduped_removed=2, stopped_by_budget=True)
    assert {tuple(x) for x in made.failures.collect()} == {(3, "call_failed: no model"), (5, dims.PARSE_JSON_FAILED)}
    cases = {x.slot: x for x in made.cases.collect()}
    assert sorted(cases) == [0, 2, 6]
    stamped = {s: json.loads(x.case)["metadata"] for s, x in cases.items()}
    assert all(m["provenance"] == "synthetic" and m["generator"] == {"engine": dims.ENGINE_LABEL, "model": "m1", "specName": "demo"} for m in stamped.values())
    assert all((m.get("review"), m.get("reviewReason")) == ((True, "judge-unavailable") if cases[s].review else (None, None)) for s, m in stamped.items())
    # every prompt was sent once an attempt: no counter computed the calls again
    assert len(sent(calls)) == len(set(sent(calls)))


def test_run_without_options_and_without_slots(spark, tmp_path):
    done = sy.synthesize(prompts(spark, 2), sy.Spec("x"), "m", client(str(tmp_path), answer))
    r = done.report.first()
    assert (r.requested, r.generated, r.failed, r.judged, r.deduped_removed, r.stopped_by_budget) == (2, 2, 0, None, None, False)
    none = sy.synthesize(prompts(spark, 0), sy.Spec("x"), "m", client(str(tmp_path), answer), judge=client(str(tmp_path), answer),
                         dedupe=0.9, max_tokens=0).report.first()
    assert (none.requested, none.generated, none.judged, none.deduped_removed, none.stopped_by_budget) == (0, 0, 0, 0, False)


def test_review_mark_keeps_other_metadata(spark):
    df = spark.createDataFrame([('{"metadata": {"a": 1}, "x": [1]}',), ('{"x": null}',)], "c string")
    got = [json.loads(r[0]) for r in df.select(sy.with_review(F.col("c"), "why")).collect()]
    assert got == [{"metadata": {"a": 1, "review": True, "reviewReason": "why"}, "x": [1]},
                   {"x": None, "metadata": {"review": True, "reviewReason": "why"}}]


def test_staged_parsing_equals_the_expression(spark):
    texts = ['```json\n{"caseId": "a"}\n```', 'x {"caseId": "b"} y', "```\n[1]\n```", '{"x": 1}', "no", '{"caseId": " "}', None, "", "}{",
             '{"caseId": 7}', '{"pass": true}', '{"pass": "yes", "score": 3}', '{"score": -1, "reason": 5}', '{"score": "0.9"}', '{"score": 0.6, "reason": "r"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    a = df.select("i", cu.parse_completion(F.col("text")).alias("parsed"))
    b = cu.with_parsed(df)
    show = lambda d: [(r.i, r.parsed.ok, r.parsed.reason, r.parsed.case_id, r.parsed.case and r.parsed.case.toJson()) for r in d.orderBy("i").collect()]
    assert show(a) == show(b)
    assert df.select("i", cu.interpret_verdict(F.col("text")).alias("verdict")).orderBy("i").collect() == \
        cu.with_verdict(df).select("i", "verdict").orderBy("i").collect()


def test_gap_filling_keeps_failed_cases(spark, tmp_path):
    cases = spark.createDataFrame([("p", 1, '{"caseId": "a", "input": "i"}'), ("p", 2, '{"caseId": "b"}'), ("q", 3, '{"caseId": "c"}')],
                                  "pack string, slot long, raw string")
    packs = spark.createDataFrame([("p", ["input", "rubric"], "custom", "general"), ("q", ["checker"], "code", "software")],
                                  "pack string, fields array<string>, task_type string, primary_industry string")
    p = sy.fill_prompts(cases, packs, lambda f: F.array_join(f, ";"))
    shown = {r.slot: r for r in p.collect()}
    assert "Industry: software. Task type: code." in shown[3].system and '"caseId": "c"' in shown[3].user and "input, rubric" in shown[1].user

    def fill(user, label):
        if "enrich-2" in label:
            return '{"input": "no id"}', 1, 1
        return '{"caseId": "z", "input": "new", "rubric": {"a": 1}, "checker": 2, "extra": 3}', 1, 1

    out = sy.fill_gaps(p, client(str(tmp_path), fill), ["input", "rubric", "checker"])
    got = {r.slot: json.loads(r.raw) for r in out.cases.collect()}
    assert got == {1: {"caseId": "a", "input": "i", "rubric": {"a": 1}}, 2: {"caseId": "b"}, 3: {"caseId": "c", "checker": 2}}
    assert [tuple(r) for r in out.failures.collect()] == [("p", 2, "b", dims.PARSE_MISSING_CASE_ID)]
    assert {r.pack: (r.input_cases, r.enriched_cases, r.failed, r.fields_targeted) for r in out.report.collect()} == {
        "p": (2, 1, 1, ["input", "rubric"]), "q": (1, 1, 0, ["checker"])}


def test_first_cases_parse_a_case_once(spark):
    """The tests are columns of a projection; inside the array each one parsed the case anew (F19)."""
    cases = spark.createDataFrame([("p", 0, '{"input": "i"}')], "pack string, seq long, raw string")
    plan = pf.first_cases(cases)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert "f_input" in generate and "raw" not in generate.replace("f_", "")
    assert [tuple(c) for r in pf.first_cases(cases).collect() if r.signal == "input" for c in r.first_cases] == [(0, "field"), (0, "text")]


def test_signal_evidence(spark):
    rows = [("p", i, '{"input": "i", "metadata": {"license": "MIT"}}') for i in range(6)] + [("p", 9, "plain train text"), ("q", 1, "{}")]
    cases = spark.createDataFrame(rows, "pack string, seq long, raw string")
    cands = spark.createDataFrame([("p", "x", "Apache-2.0", ["a"])], "pack string, cand_text string, cand_license string, cand_task_tags array<string>")
    got = {(r.pack, r.signal): r for r in pf.signal_evidence(pf.profile(cases, cands), cases).collect()}
    assert len(got) == 24
    lic = got["p", "license"]
    assert lic.evidence == ["license=Apache-2.0", "matched license"] and [tuple(c) for c in lic.first_cases] == [(0, "license"), (1, "license"), (2, "license")]
    assert got["p", "input"].evidence == ["matched input"]
    assert [tuple(c) for c in got["p", "input"].first_cases] == [(0, "field"), (0, "text"), (1, "field")]
    assert [tuple(c) for c in got["p", "split"].first_cases] == [(9, "text")]
    assert got["q", "input"].evidence == [] == got["q", "input"].first_cases and not got["q", "metadata"].present


def test_runs_leave_no_tables_behind_but_their_results(spark):
    """Tables of a run go once nothing reads them; a folder of the caller's stays."""
    import os
    from evalpack.session import ensure_checkpoint_dir
    there = lambda: set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    before = there()
    prompts = spark.createDataFrame([(i, "s", "u") for i in range(4)], "slot long, system string, user string")
    text = F.concat(F.lit('{"caseId": "c'), F.col("slot"), F.lit('", "input": "a b c d '), F.col("slot"), F.lit('"}'))
    answers = prompts.select("slot", F.lit(1).alias("attempt"), text.alias("text"), F.lit(1).cast("long").alias("prompt_tokens"),
                             F.lit(1).cast("long").alias("completion_tokens"))
    run = sy.synthesize(prompts, sy.Spec("x"), "m", sy.landed(answers), dedupe=0.95, max_tokens=100)
    assert run.cases.count() == 4 and run.failures.count() == 0
    left = {n.rsplit("-", 1)[0] for n in there() - before}
    assert "synthesis-cases" in left and not left & {"synthesis", "synthesis-slots", "synthesis-made", "tokens", "prefixes", "met", "needed"}
