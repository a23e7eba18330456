"""Curation rules on edge fixtures."""

import json

from pyspark.sql import functions as F

from evalpack.operators import curate as cu


def test_parse_completion(spark):
    texts = ['```json\n{"caseId": "a", "x": 1}\n```', 'Sure: {"caseId": "b"} ok', '```\n[1, 2]\n```',
             '{"x": 1}', 'no json here', '{"caseId": "  "}', '  \n{"caseId": "c"}\n  ']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["p"]["ok"], r["p"]["reason"], r["p"]["case_id"]) for r in
           df.select(cu.parse_completion(F.col("t")).alias("p")).collect()]
    assert got == [(True, None, "a"), (True, None, "b"), (False, "not_object", None),
                   (False, "missing_case_id", None), (False, "json_parse_failed", None),
                   (False, "missing_case_id", None), (True, None, "c")]


def test_attempt_selection(spark):
    rows = [(1, 1, "bad"), (1, 2, '{"caseId": "x"}'), (1, 3, '{"caseId": "y"}'),
            (2, 1, "bad"), (2, 2, "[1]"), (2, 3, '{"k": 1}'), (2, 4, '{"caseId": "late"}')]
    df = spark.createDataFrame(rows, "slot long, attempt int, text string") \
        .withColumn("parsed", cu.parse_completion(F.col("text"))) \
        .withColumn("prompt_tokens", F.lit(10)).withColumn("completion_tokens", F.lit(20))
    got = {r["slot"]: r for r in cu.select_attempts(df, ["slot"]).collect()}
    assert got[1]["ok"] and got[1]["case_id"] == "x" and got[1]["attempts"] == 2
    assert got[2]["ok"] and got[2]["attempts"] == 4  # every landed attempt counts


def test_token_budget_boundary_and_zero(spark):
    rows = [("p", i, 10) for i in range(6)] + [("q", i, 5) for i in range(3)]
    df = spark.createDataFrame(rows, "pack string, seq long, tokens long")
    got = {(r["pack"], r["seq"]): r["kept"] for r in cu.token_budget(df, ["pack"], "seq", "tokens", 30, 2).collect()}
    assert [got[("p", i)] for i in range(6)] == [True, True, True, False, False, False]
    zero = {(r["pack"], r["seq"]): r["kept"] for r in cu.token_budget(df, ["pack"], "seq", "tokens", 0, 4).collect()}
    assert [zero[("p", i)] for i in range(6)] == [True, False, False, False, False, False]


def test_judge_fail_open(spark):
    verdicts = spark.createDataFrame([(1, '{"pass": true}'), (2, '{"score": 0.4}'), (3, "timeout"), (4, '{"score": 7}')],
                                     "id long, t string").select("id", cu.interpret_verdict(F.col("t")).alias("verdict"))
    v = {r["id"]: r["verdict"] for r in verdicts.collect()}
    assert v[1]["score"] == 1.0 and v[1]["pass"] is True
    assert v[2]["pass"] is False and v[3] is None and v[4]["score"] == 1.0 and v[4]["pass"] is True
    cases = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    j = {r["id"]: r for r in cu.judge_filter(cases, verdicts, "id").collect()}
    assert j[2]["judge_state"] == "drop"
    assert j[3]["review"] and j[3]["review_reason"] == "judge-unavailable"
    assert j[5]["review"]


def test_provenance_overwrites_in_place(spark):
    df = spark.createDataFrame([('{"provenance": "human", "a": [1, {"b": 2}]}',)], "m string")
    out = json.loads(df.select(cu.stamp_provenance(F.col("m"), F.lit("m1"), F.lit("spec"))).first()[0])
    assert list(out) == ["provenance", "a", "generator"]
    assert out["provenance"] == "synthetic" and out["a"] == [1, {"b": 2}]
    assert out["generator"]["model"] == "m1" and out["generator"]["specName"] == "spec"


def test_merge_never_overwrites_and_null_is_present(spark):
    df = spark.createDataFrame([('{"a": null, "c": 1}', '{"a": 5, "b": {"x": [1]}, "c": 9, "z": 0}')], "o string, c string")
    out = json.loads(df.select(cu.merge_missing(F.col("o"), F.col("c"), ["a", "b", "c"])).first()[0])
    assert out == {"a": None, "c": 1, "b": {"x": [1]}}


def test_merge_into_a_value_that_is_no_object(spark):
    rows = [("[1]", '{"a": 5}'), ("not json", '{"a": 5}'), (None, '{"a": 5}'), ("{}", '{"it\'s a.b": 5}')]
    df = spark.createDataFrame(rows, "o string, c string")
    got = [r[0] for r in df.select(cu.merge_missing(F.col("o"), F.col("c"), ["a", "it's a.b"])).collect()]
    assert got[:3] == ["[1]", "not json", None]
    assert json.loads(got[3]) == {"it's a.b": 5}


def test_gap_fields_order(spark):
    df = spark.createDataFrame([(["license", "expectedOutput", "taskInstruction", "input", "rubric", "acceptanceCriteria"],)],
                               "m array<string>")
    assert df.select(cu.gap_fields(F.col("m"))).first()[0] == ["expected", "input", "rubric"]
