"""Industry segmentation: bounded keyword matches, scores, top-3 per pack.

The taxonomy is a parameter, of any number of keywords. A keyword matches a text
where its own characters stand (blank runs for blank runs) with no letter or
digit before or behind. As a keyword begins with a word, a text can only hold
keywords whose first word is one of its own: each text's distinct words are joined
with the keyword table on the first word, and the text is searched for just the
keywords found, first as a substring, then with its bounds. The table is broadcast. Matches
are made distinct (combined before the shuffle, so a pack costs at most one row
per keyword and task). Keywords that begin with another character, such as
".net", have no first word and are searched as patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import flag, keyword_pattern

_DEC = "decimal(10,4)"


def keyword_rows(taxonomy=dims.STOCK_TAXONOMY) -> list[tuple]:
    """(kw_id, slug, kind, keyword, pattern, slug_ordinal) for every keyword
    and workflow phrase of the taxonomy."""
    rows = []
    for ordinal, (slug, _label, keywords, workflows) in enumerate(taxonomy):
        for kind, items in (("keyword", keywords), ("workflow", workflows)):
            for kw in items:
                pat = keyword_pattern(kw)
                rows.append((len(rows), slug, kind, kw.lower().strip(), pat, ordinal))
    return rows


def keyword_dim(spark: SparkSession, taxonomy=dims.STOCK_TAXONOMY) -> DataFrame:
    return spark.createDataFrame(
        [r[:4] for r in keyword_rows(taxonomy)], "kw_id int, slug string, kind string, keyword string")


def taxonomy_dim(spark: SparkSession, taxonomy=dims.STOCK_TAXONOMY) -> DataFrame:
    return spark.createDataFrame(
        [(i, slug, label, list(wfs)) for i, (slug, label, _k, wfs) in enumerate(taxonomy)],
        "slug_ordinal int, slug string, label string, workflows array<string>")


def _collapsed(keyword: str) -> str:
    return re.sub(r"\s+", " ", keyword.strip().lower())


def matched_keywords(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    """(pack, kw_id) of each keyword of ``rows`` (see ``keyword_rows``) that a text (pack, text) holds; may repeat."""
    spark = texts.sparkSession
    worded = [(r[0], _collapsed(r[3])) for r in rows if re.match("[a-z0-9]", _collapsed(r[3]))]
    other = [r for r in rows if r[4] is not None and not re.match("[a-z0-9]", _collapsed(r[3]))]
    found = []
    if worded:
        table = spark.createDataFrame([(i, re.match("[a-z0-9]+", k)[0], k) for i, k in worded], "kw_id int, first string, kw string")
        bodies = texts.select("pack", F.regexp_replace(F.coalesce(F.lower("text"), F.lit("")), r"\s+", " ").alias("body"))
        words = bodies.select("pack", "body", F.explode(F.array_distinct(F.split("body", "[^a-z0-9]+"))).alias("first"))
        bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("kw"), F.lit(r"\E(?![a-z0-9])"))
        held = F.contains("body", F.col("kw")) & F.rlike("body", bounded)
        # the table is the caller's list: Spark does not know its size and would shuffle every word
        found.append(words.join(F.broadcast(table), "first").where(held).select("pack", "kw_id"))
    if other:
        hits = F.array_compact(F.array(*[F.when(flag(F.lower("text"), r[4]), F.lit(r[0])) for r in other]))
        found.append(texts.select("pack", F.explode(hits).alias("kw_id")))
    if not found:
        return texts.select("pack", F.lit(0).alias("kw_id")).limit(0)
    return found[0] if len(found) == 1 else found[0].union(found[1])


def keyword_matches(cases: DataFrame | None, taxonomy=dims.STOCK_TAXONOMY,
                    candidates: DataFrame | None = None) -> DataFrame:
    """Distinct ``(pack, kw_id, slug, kind, keyword)`` matched in any case
    or in the candidate text (``cand_industry_text``)."""
    spark = (cases if cases is not None else candidates).sparkSession
    texts = []
    if cases is not None:
        texts.append(cases.select("pack", F.col("raw").alias("text")))
    if candidates is not None:
        texts.append(candidates.select("pack", F.col("cand_industry_text").alias("text")))
    texts = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    return matched_keywords(texts, keyword_rows(taxonomy)).distinct().join(keyword_dim(spark, taxonomy), "kw_id")


def industry_scores(matches: DataFrame, taxonomy=dims.STOCK_TAXONOMY,
                    explicit: DataFrame | None = None) -> DataFrame:
    """``(pack, slug, slug_ordinal, confidence, n_keywords, n_workflows)`` for
    every slug with confidence > 0. ``explicit``: ``(pack, slug)`` domains
    named by a candidate, each worth the explicit boost."""
    spark = matches.sparkSession
    counts = matches.groupBy("pack", "slug").agg(
        F.count_distinct(F.when(F.col("kind") == "keyword", F.col("keyword"))).alias("n_keywords"),
        F.count_distinct(F.when(F.col("kind") == "workflow", F.col("keyword"))).alias("n_workflows"),
    ).withColumn("explicit", F.lit(False))
    if explicit is not None:
        ex = explicit.select("pack", "slug").distinct().select(
            "pack", "slug", F.lit(0).cast("long").alias("n_keywords"),
            F.lit(0).cast("long").alias("n_workflows"), F.lit(True).alias("explicit"))
        counts = counts.unionByName(ex).groupBy("pack", "slug").agg(
            F.max("n_keywords").alias("n_keywords"), F.max("n_workflows").alias("n_workflows"),
            F.bool_or("explicit").alias("explicit"))
    d = lambda v: F.lit(v).cast(_DEC)
    score = (F.when(F.col("explicit"), d(dims.INDUSTRY_EXPLICIT_BOOST)).otherwise(d("0"))
             + F.least(d(dims.INDUSTRY_KEYWORD_CAP), F.col("n_keywords").cast(_DEC) * d(dims.INDUSTRY_KEYWORD_STEP))
             + F.least(d(dims.INDUSTRY_WORKFLOW_CAP), F.col("n_workflows").cast(_DEC) * d(dims.INDUSTRY_WORKFLOW_STEP)))
    score = F.least(F.greatest(F.round(score, 4), d("0")), d("1")).cast(_DEC)
    tax = taxonomy_dim(spark, taxonomy).select("slug", "slug_ordinal", "label")
    return (counts.join(tax, "slug")
            .withColumn("confidence", score)
            .filter(F.col("confidence") > 0))


def industry_top(scores: DataFrame, packs: DataFrame, taxonomy=dims.STOCK_TAXONOMY,
                 k: int = dims.INDUSTRY_TOP_K) -> DataFrame:
    """Top ``k`` per pack by confidence desc, slug asc; packs with no match get
    the fallback slug. Returns ``(pack, rank, slug, label, confidence)``."""
    fb_slug = dims.INDUSTRY_FALLBACK_SLUG
    labels = {s: lab for s, lab, _k, _w in taxonomy}
    fb_label = labels.get(fb_slug, taxonomy[0][1])
    if fb_slug not in labels:
        fb_slug = taxonomy[0][0]
    # Each pack's fallback is ranked behind its matches and stays if it is the first, so that the matches are made once.
    # A null pack's fallback stays beside its matches.
    fallback = packs.select("pack").distinct().select(
        "pack", F.lit(fb_slug).alias("slug"), F.lit(fb_label).alias("label"),
        F.lit(dims.INDUSTRY_FALLBACK_CONFIDENCE).cast(_DEC).alias("confidence"), F.lit(True).alias("fallback"))
    rows = scores.select("pack", "slug", "label", "confidence", F.lit(False).alias("fallback")).unionByName(fallback)
    w = Window.partitionBy("pack", F.col("fallback") & F.col("pack").isNull()).orderBy("fallback", F.col("confidence").desc(), F.col("slug"))
    return (rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .where(~F.col("fallback") | (F.col("rank") == 1)).select("pack", "rank", "slug", "label", "confidence"))


def industry_profile(top: DataFrame, taxonomy=dims.STOCK_TAXONOMY) -> DataFrame:
    """One row per pack: primary industry, specific flag, ordered matches and
    the first three workflow hints of the primary industry."""
    spark = top.sparkSession
    lists = top.where(F.col("pack").isNotNull()).groupBy("pack").agg(
        F.array_sort(F.collect_list(F.struct("rank", "slug", "confidence"))).alias("matches"))
    first = F.element_at("matches", 1)
    prim = lists.select(
        "pack", "matches", first["slug"].alias("primary_industry"),
        ((first["slug"] != dims.INDUSTRY_FALLBACK_SLUG) & (first["confidence"] >= F.lit(dims.INDUSTRY_SPECIFIC_MIN).cast(_DEC)))
        .alias("is_industry_specific"))
    wf = taxonomy_dim(spark, taxonomy).select(
        F.col("slug").alias("primary_industry"), F.slice("workflows", 1, 3).alias("workflow_focus"))
    return prim.join(wf, "primary_industry", "left")
