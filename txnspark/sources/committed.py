"""Parquet appends whose tasks report what they wrote and whose driver publishes it at once.

A task writes one file of its own and returns its name and row counts. Only the messages of the
tasks that succeeded reach the commit, so a task that ran twice counts once. The commit publishes
one small manifest per batch under its final name, atomically and never over an older one: of two
appends of one batch, together or after each other, one lands. Files no manifest names do not
exist for readers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txnspark.session import path_exists

NAME = "committed_parquet"
MANIFESTS = "_manifests"
_MANIFEST = "batch string, files array<struct<name:string,rows:bigint>>, counts map<string,bigint>"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class TaskWrote(WriterCommitMessage):
    name: str
    rows: int
    counts: dict[str, int] = field(default_factory=dict)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.batch = options["path"].rstrip("/"), options["batch"]
        self.count_by, self.schema = options.get("countby"), schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskWrote:
        system, root = file_system(self.path)
        name = f"{self.batch}/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{root}/data/{self.batch}", recursive=True)
        rows, counts, writer = 0, Counter(), None
        schema = to_arrow_schema(self.schema)
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/data/{name}", schema, filesystem=system)
                table = pa.Table.from_batches([batch]).cast(schema)
                writer.write_table(table)
                rows += table.num_rows
                if self.count_by:
                    found = table.column(self.count_by).cast(pa.string()).value_counts()
                    counts.update({v["values"] or "": v["counts"] for v in found.to_pylist()})
        finally:
            if writer is not None:
                writer.close()
        return TaskWrote(name if rows else "", rows, dict(counts))

    def commit(self, messages: list[TaskWrote | None]) -> None:
        done = [m for m in messages if m is not None and m.rows]
        counts: Counter = Counter()
        for m in done:
            counts.update(m.counts)
        text = json.dumps({"batch": self.batch, "counts": dict(counts),
                           "files": [{"name": m.name, "rows": m.rows} for m in done]})
        if not publish(self.path, f"{self.batch}.json", text):
            self.abort(messages)  # the batch is there already

    def abort(self, messages: list[TaskWrote | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/data/{m.name}")


def publish(path: str, name: str, text: str) -> bool:
    """Writes a manifest under ``name`` unless there is one; whole or not at all."""
    system, root = file_system(path)
    folder = f"{root}/{MANIFESTS}"
    system.create_dir(folder, recursive=True)
    final, draft = f"{folder}/{name}", f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(text.encode())
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(draft, final)  # fails where the name is taken
            return True
        # HDFS refuses to rename onto a file; stores without that need one writer per batch.
        if system.get_file_info(final).type != fs.FileType.NotFound:
            return False
        system.move(draft, final)
        return True
    except OSError:
        if system.get_file_info(final).type == fs.FileType.NotFound:
            raise
        return False
    finally:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)


class CommittedParquet(DataSource):
    """Options: ``path``, ``batch`` (a name that is safe in a path) and ``countBy``, a column
    whose values are counted."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are only appended")
        return BatchWriter(self.options, schema)


def append_batch(df: DataFrame, path: str, batch: str, count_by: str | None = None) -> None:
    """Appends ``df`` as one batch, once however often it is called."""
    spark = df.sparkSession
    spark.dataSource.register(CommittedParquet)
    # Sources are looked up in the thread's active session, which a new thread has none of
    # until it makes a table.
    spark.createDataFrame([], "none int")
    writer = df.write.format(NAME).mode("append").option("path", path).option("batch", batch)
    if count_by:
        writer = writer.option("countBy", count_by)
    writer.save()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(batch, files, counts), one row per batch that landed."""
    folder = f"{path.rstrip('/')}/{MANIFESTS}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(folder)


def committed_counts(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(name, rows): counts per value of the counted column, from the manifests alone."""
    pairs = manifests(spark, path).select(F.explode("counts").alias(name, "rows"))
    return pairs.groupBy(name).agg(F.sum("rows").alias("rows"))


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows of the batches that landed."""
    names = [r["name"] for r in manifests(spark, path).select(
        F.explode("files.name").alias("name")).collect()]  # a name per file
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{n}" for n in names])
