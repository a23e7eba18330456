"""Profile, industry and plan on small fixtures with known answers."""

import json

from pyspark.sql import functions as F

from evalpack import dims
from evalpack.operators import industry as ind
from evalpack.operators import plan as pl
from evalpack.operators import profile as pf
from evalpack.operators.catalog import query_variants

BARE = [{"caseId": "b1", "messages": ["hi"]}]
GAUGE = [{"caseId": "w1", "taskType": "data_extraction", "prompt": "Read the gauge", "gold": {"mm": 4}, "tool_calls": ["gauge.read"],
          "state": {"mm": 0}, "rubric": ["units"], "metadata": {"license": "CC0-1.0"}}]
RIVER = [{"caseId": "p1", "question": "Which river?", "answer": "Loire", "documents": ["d1"]},
         {"caseId": "p2", "checker": {"kind": "regex"}, "split": "train", "criteria": ["short"]}]


def cases_df(spark, packs):
    rows = [(pack, i, json.dumps(c, separators=(",", ":"))) for pack, cs in packs.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "pack string, seq long, raw string")


def test_profiles_worked_out_by_hand(spark):
    prof = pf.profile(cases_df(spark, {"bare": BARE, "gauge": GAUGE, "river": RIVER}))
    got = {r["pack"]: r for r in prof.collect()}
    bare, gauge, river = got["bare"], got["gauge"], got["river"]
    # input alone: 0.11 x 0.86
    assert (bare["task_type"], float(bare["completeness"]), bare["readiness_level"]) == ("dialogue", 0.0946, 1)
    assert bare["missing_critical"] == ["expectedOutput", "license"]
    # 0.57 x 0.86; above 0.48, but without an input it stays at level 2
    assert (gauge["task_type"], float(gauge["completeness"]), gauge["readiness_level"]) == ("data_extraction", 0.4902, 2)
    assert gauge["missing"] == ["input", "acceptanceCriteria", "checker", "retrievalContext", "split"]
    assert gauge["evaluators"] == ["regex_match", "environment_state_test", "exact_match", "f1_match", "llm_judge", "human_label"]
    assert gauge["license_name"] == "CC0-1.0"
    # the signals of both cases count together: 0.55 x 0.86
    assert (river["task_type"], float(river["completeness"]), river["readiness_level"]) == ("rag_qa", 0.473, 2)
    assert river["missing"] == ["taskInstruction", "rubric", "toolTrace", "environmentState", "metadata", "license"]


def test_null_counts_as_present_and_license_rules(spark):
    cases = [{"caseId": "a", "expected": None, "license": 5},          # non-string license: row skipped
             {"caseId": "b", "metadata": {"licenseName": "  MIT  "}}]  # next row's license is used
    prof = pf.profile(cases_df(spark, {"p": cases})).first()
    assert prof["s_expectedOutput"] is True          # JSON null counts as present
    assert prof["license_name"] == "MIT"


def test_every_row_counts_for_patterns(spark):
    rows = [{"caseId": f"c{i}", "note": "plain"} for i in range(150)]
    assert pf.profile(cases_df(spark, {"p": rows})).first()["s_rubric"] is False
    rows.append({"caseId": "late", "note": "rubric here"})
    assert pf.profile(cases_df(spark, {"p": rows})).first()["s_rubric"] is True


def test_plan_worked_out_by_hand(spark):
    prof = pf.profile(cases_df(spark, {"gauge": GAUGE})).withColumn("primary_industry", F.lit("research"))
    p = pl.plan(prof).first()
    assert (p["current_tier"], p["target_tier"]) == ("candidate_dataset", "eval_ready_pack")
    assert [s["ordinal"] for s in p["steps"]] == [1, 4, 5, 8, 10]
    assert p["steps"][-1]["title"] == "Package as research Agent benchmark workflow"
    assert float(p["lift"]) == 0.9  # 0.4902 + 0.13 + 2 x 0.09 + 2 x 0.05
    assert p["packaging_risks"] == [dict(dims.PACKAGING_RISKS)["checker"]]


def _industry(spark, query, cases=None):
    cands = spark.createDataFrame([("q", query)], "pack string, cand_industry_text string")
    cdf = cases_df(spark, {"q": cases}) if cases else None
    m = ind.keyword_matches(cdf, dims.STOCK_TAXONOMY, candidates=cands)
    scores = ind.industry_scores(m, dims.STOCK_TAXONOMY)
    top = ind.industry_top(scores, cands.select("pack"), dims.STOCK_TAXONOMY)
    return ind.industry_profile(top, dims.STOCK_TAXONOMY).first(), top.orderBy("rank").collect()


def test_industry_needs_three_words(spark):
    prof, top = _industry(spark, "The patient met the doctor at the hospital")
    assert (prof["primary_industry"], prof["is_industry_specific"]) == ("healthcare", True)
    assert float(top[0]["confidence"]) == 0.33 and prof["workflow_focus"] == ["medical QA", "patient intake", "clinical summarization"]
    prof, top = _industry(spark, "a clinical medicine note")
    assert (prof["primary_industry"], prof["is_industry_specific"], float(top[0]["confidence"])) == ("healthcare", False, 0.22)
    prof, top = _industry(spark, "a clinical medicine note", [{"caseId": "h1", "input": "triage"}])
    assert (prof["is_industry_specific"], float(top[0]["confidence"])) == (True, 0.33)


def test_industry_words_are_bounded(spark):
    prof, top = _industry(spark, "beta transformation, classified")  # holds "eta" and "form" inside words only
    assert (prof["primary_industry"], float(top[0]["confidence"]), [r["slug"] for r in top]) == ("general", 0.2, ["general"])


def test_query_variants(spark):
    df = spark.createDataFrame([("Weather Agent planning  dataset for ships",), ("  testing \t eval ",)], "q string")
    got = [r[0] for r in df.select(query_variants(F.col("q"))).collect()]
    assert got == [["Weather Agent planning dataset for ships", "Weather planning for ships", "Weather Agent"], ["testing eval"]]
