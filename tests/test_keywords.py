"""Keyword matching by first words against one pattern a keyword, and with thousands of keywords."""

import random
import re

from pyspark.sql import functions as F

from evalpack import dims
from evalpack.functions.text import keyword_pattern
from evalpack.operators import industry as ind


def plain(texts, rows):
    return {(p, r[0]) for p, t in texts for r in rows if r[4] and t is not None and re.search(r[4], t.lower(), re.ASCII)}


def test_equals_one_pattern_a_keyword(spark):
    rng = random.Random(8)
    words = ["a", "b1", "co", "op", "c", "net", "é", "tion"]
    seps = [" ", "  ", "-", "\n\t", "+", "++ ", ".", "", "/", "é"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(seps) for _ in range(n))
    keywords = sorted({make(rng.randrange(1, 4)) for _ in range(150)} | {"co-op", "c++", ".net", "a  b1", "  co op ", "+", "", "tion", "é co", "A"})
    taxonomy = [("x", "X", keywords[::2], keywords[1::2])]
    texts = [(f"p{i}", make(rng.randrange(0, 12))) for i in range(300)] + [("n", None), ("e", ""), ("c", "c++"), ("d", "c++a"), ("f", "x.net net")]
    rows = ind.keyword_rows(taxonomy)
    df = spark.createDataFrame(texts, "pack string, text string")
    got = {(r.pack, r.kw_id) for r in ind.matched_keywords(df, rows).collect()}
    assert got == plain(texts, rows) and len(got) > 300
    assert ind.matched_keywords(df, []).count() == 0


def test_ten_thousand_keywords(spark):
    taxonomy = [(f"s{i}", f"S{i}", [f"word{i}x{j} tail{j}" for j in range(50)], []) for i in range(200)]
    cases = spark.range(400).select((F.col("id") % 7).cast("string").alias("pack"),
                                    F.concat(F.lit("about word"), F.col("id").cast("string"), F.lit("x3  TAIL3, and word"),
                                             F.col("id").cast("string"), F.lit("x4 tail44")).alias("raw"))
    got = ind.keyword_matches(cases, taxonomy)
    plan = got._jdf.queryExecution().toString()
    assert len(plan) < 200_000 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r.pack, r.slug, r.keyword) for r in got.collect()} == {(str(i % 7), f"s{i}", f"word{i}x3 tail3") for i in range(200)}


def test_stock_taxonomy(spark):
    cases = spark.createDataFrame([("p", "A Pull  Request for e-commerce; HR-policy, refunds"), ("q", "taxonomies")], "pack string, raw string")
    got = {(r.slug, r.keyword) for r in ind.keyword_matches(cases, dims.STOCK_TAXONOMY).collect()}
    assert got == {("software", "pull request"), ("ecommerce", "e-commerce"), ("hr", "hr"), ("hr", "policy"), ("legal", "policy")}
    assert keyword_pattern(" ") is None


def test_words_are_not_shuffled(spark):
    """The keyword table is broadcast: only distinct matches are shuffled, not every word of every text."""
    from evalpack.operators import industry as ind
    texts = spark.createDataFrame([("p", "payment fraud in banking")], "pack string, text string")
    plan = ind.matched_keywords(texts, ind.keyword_rows())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
