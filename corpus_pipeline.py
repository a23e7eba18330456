"""A training corpus from raw documents: quality, exact and near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with
all their columns; the last returns the packed pieces. A row's decision is that
of its doc_id (null ids match null ids), for exact duplicates of its doc_id and
text. Empty tables pass through; columns beside doc_id, text and lang are
carried and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalpack.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from evalpack.llm.common import read, stored


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``dropped``."""
    gone = _free(docs, "dropped")
    ids = dropped.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents above their language's perplexity threshold."""
    return _without(docs, quality.quality(docs, read(spark, sf_dir, "labels")).where("NOT kept"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of equal texts."""
    gone, digest = _free(docs, "dropped"), _free(docs, "dropped_sha")
    drop = exact_dedup.exact_dedup(docs).where("NOT kept").select(
        F.col("doc_id").alias(gone), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(F.encode(exact_dedup.normalised(), "UTF-8"), 256)
    return docs.join(drop, F.col("doc_id").eqNullSafe(F.col(gone)) & (sha == F.col(digest)), "left_anti")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate component."""
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without(docs, decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", keep_first_copies),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: SQL cannot express the language model, the latent retrieval or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``, each written and read again in between."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
