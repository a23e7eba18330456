"""A sink of one pretty JSON document per row: ``df.write.format("json_documents")``.

Rows are (name, document JSON text). Tasks write into a folder of the job beside the target;
each document gets its name there when it is whole, so a task that runs twice, or is cut off,
leaves no half of one. When all tasks are done the job's folder takes the target's place with
one rename (``overwrite``), or its documents are moved into it (``append``), and ``_SUCCESS`` is
added. A job that fails drops its folder: the target stays as it was, whatever tasks that still
run go on to write. The driver handles files, never documents.

The path is any that pyarrow's file systems open (local or shared folders, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "json_documents"
HALF = ".half"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(name: str) -> str:
    """The document's file: other characters than letters, digits and ``_.-~`` are percent-encoded."""
    return f"{quote(name, safe='')}.json"


class JsonDocumentsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f".job-{uuid.uuid4().hex}"
        store, folder = _folder(self.path)
        store.create_dir(folder + self.job, recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = _folder(self.path)
        for row in iterator:
            place = f"{folder}{self.job}/{file_name(row['name'])}"
            body = json.dumps(json.loads(row["document"]), indent=2, ensure_ascii=False) + "\n"
            half = f"{place}.{uuid.uuid4().hex}{HALF}"
            with store.open_output_stream(half) as out:
                out.write(body.encode())
            store.move(half, place)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        store, folder = _folder(self.path)
        made = [f for f in store.get_file_info(fs.FileSelector(folder + self.job)) if f.type == fs.FileType.File]
        for cut in made:  # of attempts that were cut off
            if cut.path.endswith(HALF):
                store.delete_file(cut.path)
        there = store.get_file_info(folder).type == fs.FileType.Directory
        if there and not self.overwrite:
            for f in made:
                if not f.path.endswith(HALF):
                    store.move(f.path, f"{folder}/{f.base_name}")
            store.delete_dir(folder + self.job)
        else:
            if there:
                store.delete_dir(folder)
            store.move(folder + self.job, folder)
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, folder = _folder(self.path)
        store.delete_dir(folder + self.job)


class JsonDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["name", "document"]:
            raise ValueError("rows of json_documents are (name, document)")
        return JsonDocumentsWriter(self.options["path"], overwrite)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes (name, document) rows as documents below ``path``."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(JsonDocuments)
    df.select("name", "document").write.format(FORMAT).mode(mode).save(path)
