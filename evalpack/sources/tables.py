"""Readers for the landed parquet tables and the stand-in views built from
them. Column selection is explicit so Catalyst prunes the parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Regex for a license line inside free text (stand-in for a license field).
LICENSE_LINE = r"(?m)^[^\n]*[Ll]icen[cs]e[^\n]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Spark's ``spark.sql.files.*`` settings decide the splits."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def license_from_text(text_col: str = "text"):
    """Trimmed first line that mentions a license, else NULL."""
    text = F.col(text_col)
    line = F.trim(F.regexp_extract(text, LICENSE_LINE, 0))
    return F.when((text.contains("icense") | text.contains("icence")) & (line != ""), line)


def documents_as_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver stand-in: a pack is ``documents.source``, a case one document in
    ``doc_id`` order, its text the case payload and its license line the case
    license."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("pack"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("raw"),
        license_from_text("text").alias("license"),
    )
