"""Near-duplicate jobs over the driver tables: documents (token Jaccard,
order = ``doc_id``) and embeddings (cosine, order = ``vec_id``).

The embeddings' largest pair cosine is about 0.51, so the stock threshold
0.92 finds nothing; the registered cosine queries use 0.40 (the stock value
is exercised in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import dedupe as dd
from ..sources.tables import table

JACCARD_T = dims.DEDUPE_JACCARD_THRESHOLD
COSINE_T = 0.40


def _jaccard(spark, sf, first_only=True):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs, *dd.jaccard_pairs(docs, "doc_id", F.col("text"), JACCARD_T, first_only)


def jaccard_pairs(spark, sf):
    _d, pairs, _g = _jaccard(spark, sf, first_only=False)
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard")


def dedupe_jaccard(spark, sf):
    docs, pairs, groups = _jaccard(spark, sf)
    kept = dd.keep_first(docs.select(F.col("doc_id").alias("id")), pairs, groups)
    return kept.select(F.col("id").alias("doc_id"), "kept")


def _cosine(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return emb, *dd.cosine_pairs(emb, "vec_id", "embedding", COSINE_T)


def cosine_pairs(spark, sf):
    _e, pairs, _g = _cosine(spark, sf)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), "cosine")


def dedupe_cosine(spark, sf):
    emb, pairs, groups = _cosine(spark, sf)
    kept = dd.keep_first(emb.select(F.col("vec_id").alias("id")), pairs, groups)
    return kept.select(F.col("id").alias("vec_id"), "kept")


def dedupe_counters(spark, sf):
    docs, pairs, groups = _jaccard(spark, sf)
    kept = dd.keep_first(docs.select(F.col("doc_id").alias("id")), pairs, groups)
    return dd.dedupe_counters(kept)
