"""Shapes of plans that keep costs in proportion: no step done twice, no wide rows moved."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from evalpack.operators import catalog as ct
from evalpack.operators import facts as fx
from evalpack.operators import industry as ind

SMOKE = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metric_records_parse_each_concept_once(spark):
    docs = spark.createDataFrame([(1, '{"facts":{"us-gaap":{"Assets":{"units":{"EUR":[{"val":1}],"USD":[{"val":2,"fy":2020,"form":"10-K","filed":"a",'
                                      '"end":"b"},{"val":"3"},null,5]}},"Liabilities":{"units":{"USD":{"val":1}}},"ProfitLoss":5}}}'),
                                  (2, "no JSON"), (3, None)], "id int, doc string")
    records = fx.metric_records(docs, "doc", ["id"])
    plan = optimized(fx.usable_records(records))
    assert plan.count("from_json") == 2 and "get_json_object" not in plan  # one of the document, one of a concept
    rows = [(r.id, r.concept, r.used_unit, r.pos, r.val, r.fy, r.form) for r in records.orderBy("id", "pos").collect()]
    assert rows == [(1, "Assets", "USD", 0, 2.0, "2020", "10-K"), (1, "Assets", "USD", 1, None, None, None),
                    (1, "Assets", "USD", 2, None, None, None), (1, "Assets", "USD", 3, None, None, None)]


def test_texts_are_searched_for_keywords_once(spark):
    plan = optimized(e.queries()["live_domains"](spark, SMOKE))
    assert plan.count("regexp_replace(") == 1


def test_fallback_beside_matches_and_null_packs(spark):
    cases = spark.createDataFrame([("p", "thing one"), ("q", "nothing"), (None, "thing")], "pack string, raw string")
    taxonomy = [("alpha", "Alpha", ["thing"], []), ("general", "General", [], [])]
    top = ind.industry_top(ind.industry_scores(ind.keyword_matches(cases, taxonomy), taxonomy), cases, taxonomy)
    got = sorted(((r.pack or "", r.rank, r.slug) for r in top.collect()))
    assert got == [("", 1, "alpha"), ("", 1, "general"), ("p", 1, "alpha"), ("q", 1, "general")]


def test_rules_search_substrings_before_patterns(spark):
    text = F.col("text")
    rows = spark.createDataFrame([("A Benchmark.",), ("benchmarks",), ("my datasets",), ("corpus",), ("corpuses",), ("rag video",), (None,)], "text string")
    out = rows.select(ct.repo_record_kind(text).alias("kind"), F.array_join(ct.task_tags(text), ",").alias("tags"),
                      F.array_join(ct.modality_tags(text), ",").alias("modes"))
    plan = optimized(out)
    assert "Contains" in plan and len(re.findall("RLIKE", plan)) <= 3
    assert [tuple(r) for r in out.collect()] == [
        ("benchmark", "benchmark", "text"), ("repository", "benchmark", "text"), ("dataset", "benchmark", "text"),
        ("dataset", "benchmark", "text"), ("repository", "benchmark", "text"), ("repository", "rag_qa", "text,video"),
        ("repository", "benchmark", "text")]


@pytest.mark.parametrize("key", ["recent_filings"])
def test_no_url_is_sorted_or_moved(spark, key):
    plan = optimized(e.queries()[key](spark, SMOKE))
    below = plan[plan.index("Window"):]
    assert "sec.gov" in plan and "sec.gov" not in below
