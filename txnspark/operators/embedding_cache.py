"""Embeddings kept between runs, never those of other data, tokens or another embedder.

A generation of the cache is named by digests of the vocabulary and the embedder beside the
target and row budget. Inside it ``rows`` lists row ids with a hash of the ids they were embedded
from, and ``vectors`` holds one vector per different id list, however many rows share it. A changed
vocabulary or embedder therefore opens another generation, and a row whose content changed with a
new ingest misses. What is missing is appended as committed batches, vectors before the rows that
need them, so a run that fails half way leaves no row without its vector, and ``forget`` drops the
generations of a target.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyarrow.fs import FileSelector
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.operators.vectors import Embedder, embedding_column
from txnspark.session import path_exists
from txnspark.sources import committed


def vocabulary_digest(vocabulary: DataFrame) -> str:
    """Of the (token, id) pairs, in whatever order they are stored."""
    mark = F.xxhash64("token", "id").cast("decimal(38,0)")
    other = F.xxhash64("id", "token").cast("decimal(38,0)")
    row = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("a"),
                         F.sum(other).alias("b")).first()
    return hashlib.sha256(f"{row['n']}:{row['a']}:{row['b']}".encode()).hexdigest()[:16]


def embedder_digest(embedder: Embedder) -> str:
    return hashlib.sha256(cloudpickle.dumps(embedder)).hexdigest()[:16]


@dataclass(frozen=True)
class EmbeddingCache:
    """Vectors of one target (a table's name) and row budget under ``root``."""

    spark: SparkSession
    root: str
    target: str
    budget: str = "all"

    @property
    def _home(self) -> str:
        return f"{self.root.rstrip('/')}/{self.target}"

    def _generation(self, vocabulary: DataFrame, embedder: Embedder) -> str:
        return (f"{self._home}/n={self.budget}/"
                f"{vocabulary_digest(vocabulary)}-{embedder_digest(embedder)}")

    def embed(self, encoded: DataFrame, vocabulary: DataFrame, embedder: Embedder,
              key: str = "row_id", ids: str = "ids") -> tuple[DataFrame, int]:
        """((key, embedding) of every row of ``encoded``, number of rows that were not kept)."""
        path = self._generation(vocabulary, embedder)
        kind, id_kind = (encoded.schema[c].dataType.simpleString() for c in (key, ids))
        rows = encoded.select(key, F.col(ids).alias("_ids"), F.xxhash64(ids).alias("ids_hash"))
        known = committed.read_committed(
            self.spark, f"{path}/rows", f"{key} {kind}, ids_hash long").select(
            F.col(key).alias("_key"), F.col("ids_hash").alias("_hash"))
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("ids_hash") == F.col("_hash"))
        vectors = lambda: committed.read_committed(
            self.spark, f"{path}/vectors", f"ids {id_kind}, embedding array<float>").withColumnRenamed(
            "ids", "_of")
        # Runs at the same time may both have landed a list.
        once = lambda: vectors().dropDuplicates(["_of"])
        of = F.col("_ids").eqNullSafe(F.col("_of"))
        # Only id lists are grouped and joined; a vector is made where it is written.
        new = rows.select("_ids").distinct().join(vectors().select("_of"), of, "left_anti")
        self._append(new.select(F.col("_ids").alias("ids"), embedding_column(
            embedder, F.col("_ids")).alias("embedding")), f"{path}/vectors")
        missing = rows.join(known, same, "left_anti").select(key, "ids_hash")
        return (rows.join(once(), of).select(key, "embedding"),
                self._append(missing, f"{path}/rows"))

    def _append(self, df: DataFrame, path: str) -> int:
        """Rows that landed with the next batch."""
        batch = f"b{committed.manifests(self.spark, path).count()}"
        committed.append_batch(df, path, batch)
        return committed.manifests(self.spark, path).where(F.col("batch") == batch).select(
            F.coalesce(F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["rows"]),
                       F.lit(0)).alias("n")).first()["n"]

    def generations(self) -> list[str]:
        """Names of the generations of this target and budget."""
        path = f"{self._home}/n={self.budget}"
        if not path_exists(self.spark, path):
            return []
        system, root = committed.file_system(path)
        return sorted(f.base_name for f in system.get_file_info(FileSelector(root)))

    def forget(self) -> None:
        """Drops all vectors of the target, whatever their budget; for after a re-ingest."""
        if path_exists(self.spark, self._home):
            system, root = committed.file_system(self._home)
            system.delete_dir(root)
