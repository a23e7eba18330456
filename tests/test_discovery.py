"""Search index and cascade against a plain search; discovery over two catalogs on a fixture with known answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evalpack import dims
from evalpack.operators import catalog as ct
from evalpack.operators import discovery, search


def plain_cascade(variants, docs, limit):
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    out = {}
    for qid, scope in {(q, s) for q, s, _, _ in variants}:
        found = []
        for _, _, k, text in sorted(v for v in variants if v[:2] == (qid, scope)):
            if len(found) >= limit:
                break
            hits = sorted((p, d) for s, d, p, t in docs if s == scope and words(text) <= words(t))[:limit]
            found += [(d, k) for _, d in hits if d not in [x for x, _ in found]]
        out[qid, scope] = [(d, k, i + 1) for i, (d, k) in enumerate(found[:limit])]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("limit", [1, 3])
def test_cascade_equals_plain_search(spark, limit):
    rng = random.Random(limit)
    text = lambda n: " ".join(rng.choice("the of cat dog bird x1 rare".split()[:rng.choice([2, 7])]) for _ in range(n))
    docs = [(s, f"d{i}", (i * 7) % 50, text(rng.randrange(6))) for s in (0, 1) for i in range(50)]
    variants = [(q, s, k, text(rng.randrange(1, 5)) if q else "?!") for q in range(30) for s in (0, 1) for k in range(1, 4)]
    variants += [(99, 0, 1, "unknown word"), (98, 1, 1, "Cat, the CAT")]
    index = search.build_index(spark.createDataFrame(docs, "scope int, doc string, place int, text string"))
    found = search.cascade(spark.createDataFrame(variants, "qid int, scope int, k int, variant string"), index, limit)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.qid, r.scope), []).append((r.doc, r.k, r["rank"]))
    assert got == plain_cascade(variants, docs, limit)


def test_probe_reads_buckets_and_explodes_no_document(spark):
    docs = spark.range(200).select(F.lit(0).alias("scope"), F.col("id").alias("doc"), F.col("id").alias("place"),
                                   F.concat(F.lit("a b w"), F.col("id").cast("string")).alias("text"))
    index = search.build_index(docs)
    variants = spark.createDataFrame([(0, ["a", "w7"], "a w7")], "scope int, tokens array<string>, key string")
    hits = search.probe(variants, index, 5)
    assert [r.doc for r in hits.collect()] == [7]
    plan = hits._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket.* IN \(", plan)
    assert "regexp_extract_all" not in plan and "Cartesian" not in plan


def test_empty_batches(spark):
    docs = spark.createDataFrame([(0, "d", 1, "a")], "scope int, doc string, place int, text string")
    none = spark.createDataFrame([], "qid int, scope int, k int, variant string")
    assert search.cascade(none, search.build_index(docs), 3).count() == 0
    assert search.cascade(spark.createDataFrame([(1, 0, 1, "a")], none.schema), search.build_index(docs.limit(0)), 3).count() == 0


HUB = ("seq long, id string, author string, gated boolean, disabled boolean, description string, downloads long, likes long, "
       "created_at string, last_modified string, tags array<string>")
REPO = ("seq long, id long, full_name string, html_url string, description string, topics array<string>, language string, "
        "private boolean, visibility string, spdx_id string, stars long")


def sources(spark):
    hub = spark.createDataFrame([
        (0, "acme/loans", "acme", False, False, "bank loan questions with expected answer and rubric", 10, 1, None, None,
         ["license:mit", "task_categories:question-answering", "language:en"]),
        (1, "acme/loans", "acme", True, False, "bank loan claims", 5, 1, None, None, ["license:mit"]),
        (2, "gone/loans", "x", False, True, "bank loan", 99, 0, None, None, []),
        (3, "zeta/loans", None, None, None, "a loan of a bank, unit_test checker, train split, input, expected, license",
         50, None, None, None, ["license:cc-by-nc-4.0", "benchmark"])], HUB)
    repo = spark.createDataFrame([
        (0, 7, "x/loans", "https://github.com/x/loans", "bank loan fraud agent", ["Risk"], "Python", False, "public", "MIT", 3),
        (1, 8, "x/other", "https://github.com/x/other", "weather", None, None, False, None, None, 900)], REPO)
    return [ct.normalize_hub(hub), ct.normalize_repo(repo)]


def test_discover(spark):
    queries = spark.createDataFrame([(1, "bank loan benchmark"), (2, "weather"), (3, "nothing here"), (4, " ")], "qid int, query string")
    rows = discovery.discover(queries, sources(spark), 4, dims.STOCK_TAXONOMY).collect()
    got = {(r.qid, r["rank"]): r for r in rows}
    # the first variant finds nothing, the next ("bank loan") does; the later row of acme/loans wins; the disabled one is gone
    assert [(got[1, i].source, got[1, i].id) for i in (1, 2, 3)] == [("hub", "zeta/loans"), ("hub", "acme/loans"), ("repo", "7")]
    assert {r.qid for r in rows} == {1, 2} and got[2, 1].id == "8" and len(rows) == 4
    zeta, acme, repo = (got[1, i] for i in (1, 2, 3))
    assert zeta.readiness_level > acme.readiness_level
    for row, text in ((acme, "claims"), (zeta, "unit_test")):
        cand = row.candidate.toPython()
        assert text in cand["summary"] and cand["rawPayload"]["description"] == cand["summary"]
        assert cand["sourceUrl"] == dims.HUB_PAGE + row.id and cand["downloadUrl"].endswith("README.md") and "domains" in cand
    assert acme.candidate.toPython()["commercialRisk"] == "restricted" == zeta.candidate.toPython()["redistributionRisk"]
    assert repo.candidate.toPython()["metadata"] == {"topics": ["risk"], "stars": 3, "visibility": "public"}
    # finance by its words, its own name among the domains, and as an explicit domain
    assert repo.primary_industry == "finance" and repo.is_industry_specific
    assert repo.industry_matches[0].matched_keywords == ["finance", "bank", "risk", "fraud", "loan"]
    assert float(repo.industry_matches[0].confidence) == 0.9
    assert repo.plan.industry == "finance" and repo.plan.workflow_focus == ["claim review", "risk analysis", "complaint classification"]
    assert repo.plan.steps[-1].title == "Package as finance Agent benchmark workflow" and repo.plan.steps[-1].inputs[0] == "industry taxonomy"


def test_discover_limit_and_one_source(spark):
    queries = spark.createDataFrame([(1, "bank loan")], "qid int, query string")
    hub, repo = sources(spark)
    assert [r.id for r in discovery.discover(queries, [hub], 1).collect()] == ["zeta/loans"]
    # one of each source at most; the better one leads
    assert [(r["rank"], r.id) for r in discovery.discover(queries, [repo, hub], 1).orderBy("rank").collect()] == [(1, "zeta/loans")]
