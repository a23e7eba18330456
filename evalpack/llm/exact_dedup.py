"""Exact deduplication as a stateful stream.

Rows arrive as (digest, doc_id, locator). A streaming aggregation keeps, for
each digest and without expiry, the smallest doc_id seen, the file that holds
it and the number of rows, in RocksDB state stores below the stream's
checkpoint. A later run on the same checkpoint continues where the last one
stopped. The state is then read back and joined to the rows. Of every digest
seen more than once, the whole normalised texts are fetched and compared with
the text that stays; rows that differ (a digest collision) are grouped by
their bytes instead.

Partial minima and counts combine before the shuffle, so a digest shared by a
third of all rows costs one row a task; the joins back are ordinary joins whose
large partitions Spark splits.

Defined results: null and empty texts are equal to each other (one blank is a
text of its own); a null doc_id is never the smallest (if all are null, keep_id
is null and the rows stay); rows that repeat both doc_id and text count in
group_size and stay or go together; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, read, shared_folder, stored

BYTES_PER_BATCH = 16 << 30
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # Many small stores: files take the space that they need, not what is set aside for them.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.metricsEnabled": "false",
}

ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


@contextmanager
def _state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))


def keyed_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a stream of (digest, doc_id, locator) to its present end and returns
    the state: digest, keep_id, locator, group_size."""
    spark = stream.sparkSession
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")
    state = stream.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    with _state_settings(spark):
        (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        kept = spark.read.format("statestore").load(checkpoint)
        first, n = (f"value.`{f.name}`" for f in kept.schema["value"].dataType.fields)
        # Written while the settings hold: reading the state needs its provider.
        return stored(kept.select(
            F.col("key.digest").alias("digest"), F.col(f"{first}.doc_id").alias("keep_id"),
            F.col(f"{first}.locator").alias("locator"), F.col(n).alias("group_size")), "state")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                bytes_per_batch: int = BYTES_PER_BATCH, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    spark, docs = docs.sparkSession, columns(docs, "doc_id", "text")
    rows = stored(docs.select("doc_id", digest(normalised()).alias("digest"),
                              F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("text_sha256"),
                              F.input_file_name().alias("locator")), "keys")
    folder = rows.inputFiles()[0].rpartition("/")[0]
    source = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", bytes_per_batch)
    if files_per_batch:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch)
    state = keyed_state(source.parquet(folder).select("digest", "doc_id", "locator"), shared_folder(spark, "stream"))

    hits = state.where("group_size > 1")
    texts = stored(docs.select("doc_id", normalised().alias("body"), digest(normalised()).alias("digest"))
                   .join(hits.select("digest"), "digest", "left_semi"), "hits")
    stays = texts.join(hits.select("digest", "keep_id"), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = stays.groupBy("digest").agg(F.min("body").alias("stays"))
    differ = stored(texts.join(stays, "digest").where("body <> stays").select("doc_id", "digest", "body"), "differ")

    out = rows.select("doc_id", "digest", "text_sha256").join(state.drop("locator"), "digest")
    if differ.limit(1).count():
        out = _regrouped(out, differ)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def _regrouped(out: DataFrame, differ: DataFrame) -> DataFrame:
    """Groups of equal bytes among rows whose digest is that of another text."""
    groups = differ.groupBy("digest", "body").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_n"))
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    groups = groups.select(F.col("digest").alias("d"), F.sha2(F.encode("body", "UTF-8"), 256).alias("sha"), "own_id", "own_n")
    return (out.join(lost, "digest", "left")
            .join(groups, (F.col("digest") == F.col("d")) & (F.col("text_sha256") == F.col("sha")), "left")
            .withColumn("group_size", F.coalesce("own_n", F.col("group_size") - F.coalesce("lost", F.lit(0))))
            .withColumn("keep_id", F.when(F.col("own_n").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id"))))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup(read(spark, sf_dir, "documents"))
