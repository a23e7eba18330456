"""What several operators share: reading tables, shared scratch tables, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's reader only (any store Spark can open)."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession):
    """Queries that are built and run inside lose their shuffle files when they end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def fuller_tasks(spark: SparkSession, size: str = "16m"):
    """Shuffled partitions are joined up to ``size`` each, not spread over all cores: queries of many short
    stages start fewer tasks and write fewer files."""
    wanted = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, path: str, by: str | None = None) -> None:
    """Writes ``df`` as Parquet (a folder for each value of ``by``); its shuffle files are dropped as soon as the table is there."""
    with short_shuffles(df.sparkSession):
        df.select("*").write.parquet(path, partitionBy=by)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once,
    and a lost executor costs a re-read, not a recomputation."""
    path = shared_folder(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: the last column, whose values can be dropped one by one."""
        path = shared_folder(self.spark, name)
        written(df, path, by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame, part: str = "") -> None:
        """Deletes the given tables of this scratch (without any given: all), or only a folder of theirs."""
        for key in [id(t) for t in tables] or list(self.paths):
            at = f"{self.paths[key][1]}/{part}" if part else self.paths.pop(key)[1]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
             schema: str) -> DataFrame:
    """Applies ``work`` to each Arrow batch of ``df``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if made is None:
                    continue
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
    return df.mapInArrow(run, schema)


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; other columns of the input, whatever their names, are left out."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
