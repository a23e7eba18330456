"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Spark drops the shuffle files of a query when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once,
    its lineage is cut, and a lost executor costs a read, not a recomputation."""
    path = shared_folder(df.sparkSession, name)
    written(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Queries that are built and run inside have these settings."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Writes ``df`` as Parquet; its shuffle files are dropped as soon as the table is there."""
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.select("*").write.partitionBy(*partition_by).mode(mode).parquet(path)


class Scratch:
    """Stored tables that are deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def folder(self, name: str) -> str:
        """A new shared folder that goes with this scratch."""
        path = shared_folder(self.spark, name)
        self.paths[path] = (path, path)
        return path

    def stored(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = shared_folder(self.spark, name)
        written(df, path, partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def tables(self) -> list:
        """The tables and folders that are there."""
        return [t for t, _ in self.paths.values()]

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes the given tables or folders of this scratch (without any given: all)."""
        for key in [t if isinstance(t, str) else id(t) for t in tables] or list(self.paths):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[1])
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
