"""Catalog rules: license risk by source, record kinds, keyed dedupe, quota."""

from pyspark.sql import functions as F

from evalpack.operators import catalog as ct


def test_license_risk(spark):
    rows = [("CC-BY-4.0", False), ("CC-BY-NC-4.0", False), ("CC BY-NC 4.0", False), ("mit", True),
            (None, False), ("GPL-3.0", False), ("CC-BY-SA-4.0", False), ("LGPL-2.1", False)]
    df = spark.createDataFrame(rows, "l string, f boolean")
    hub = [r[0] for r in df.select(ct.license_risk(F.col("l"), F.col("f"), "hub")).collect()]
    repo = [r[0] for r in df.select(ct.license_risk(F.col("l"), F.col("f"), "repo")).collect()]
    assert hub == ["low", "restricted", "medium", "restricted", "unknown", "medium", "low", "medium"]
    assert repo == ["medium", "restricted", "medium", "restricted", "unknown", "medium", "medium", "medium"]


def test_record_kind(spark):
    df = spark.createDataFrame([("A Benchmark suite",), ("my datasets",), ("xcorpus",), ("corpusx",), ("tools",)], "t string")
    assert [r[0] for r in df.select(ct.repo_record_kind(F.col("t"))).collect()] == \
        ["benchmark", "dataset", "dataset", "repository", "repository"]


def test_keyed_dedupe_last_value_first_position(spark):
    df = spark.createDataFrame([("hub", "a", 0, "v1"), ("hub", "b", 1, "w"), ("hub", "a", 2, "v2")],
                               "source string, id string, seq long, title string")
    got = {r["id"]: (r["position"], r["title"]) for r in ct.dedupe_by_key(df, ["source", "id"]).collect()}
    assert got == {"a": (0, "v2"), "b": (1, "w")}


def test_tags(spark):
    df = spark.createDataFrame([(["license:mit", "language:en", "language:", "language:fr", "benchmark"],)], "t array<string>")
    r = df.select(ct.tag_values(F.col("t"), "language:").alias("l"), ct.first_tag_value(F.col("t"), "license:").alias("x")).first()
    assert r["l"] == ["en", "fr"] and r["x"] == "mit"
    t = spark.createDataFrame([("RAG agent for image code",), ("nothing",)], "t string")
    got = t.select(ct.task_tags(F.col("t")), ct.modality_tags(F.col("t"))).collect()
    assert got[0][0] == ["rag_qa", "tool_use", "code"] and got[0][1] == ["text", "image"]
    assert got[1][0] == ["benchmark"] and got[1][1] == ["text"]


def test_candidate_domains_stock_taxonomy(spark):
    from evalpack import dims
    from evalpack.operators import industry as ind
    cands = spark.createDataFrame([("a", "customer support refund tickets for an online shop"),
                                   ("b", "metadata format:csv generated dataset")], "pack string, cand_industry_text string")
    got = {r["pack"]: r["domains"] for r in ct.candidate_domains(cands, dims.STOCK_TAXONOMY).collect()}
    assert got["a"][0] == "customer-service" and "general" not in got["a"]
    assert got["b"] == ["general"]
    # second pass: an explicit domain adds 0.45 to that slug
    m = ind.keyword_matches(None, dims.STOCK_TAXONOMY, candidates=cands.filter("pack = 'b'"))
    explicit = spark.createDataFrame([("b", "finance")], "pack string, slug string")
    scores = {r["slug"]: float(r["confidence"]) for r in ind.industry_scores(m, dims.STOCK_TAXONOMY, explicit).collect()}
    assert scores == {"finance": 0.45}
