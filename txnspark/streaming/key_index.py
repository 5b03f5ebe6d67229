"""Index of landed keys: hash buckets in generations, each with a Bloom filter.

A batch of keys asks the filters of the buckets it falls into and opens only the files of those
(bucket, generation) pairs that some key may be in; rows never seen, the usual case, open almost
nothing. Every batch adds a generation at level 0. ``FAN`` generations of one level are merged
into one of the next, so the number alive, and with it what a batch asks, grows with the
logarithm of the number of batches. Each batch leaves a manifest of the generations alive after
it and reads the manifest of the batch before, so a replayed batch finds what it found at first.

Filters take ``BITS`` bits a key and lie beside the keys, one row per bucket and generation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnspark.session import materialize, path_exists
from txnspark.streaming.jobs import write_batch

BUCKETS = 64
FAN = 4
BITS = 10
PROBES = 7
FILTER_KEYS = 4_000_000  # keys of one filter at most; a larger bucket has several

_MANIFEST = "generation string, level int, n long"


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of each hash in a filter of ``size`` bits, one row per probe."""
    h = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(size) for k in range(PROBES)])


def build_filter(hashes: np.ndarray) -> bytes:
    size = max(64, len(hashes) * BITS)
    marks = np.zeros(size, dtype=bool)
    marks[_bits(hashes, size).ravel()] = True
    return size.to_bytes(8, "little") + np.packbits(marks).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    size = int.from_bytes(filter_[:8], "little")
    marks, at = np.frombuffer(filter_, np.uint8, offset=8), _bits(hashes, size)
    hit = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
    return hit.all(axis=0)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of keys sorted by bucket, one or more rows a bucket."""
    def made(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([build_filter(hashes)]),
             pa.array([int(hashes.min())]), pa.array([int(hashes.max())])],
            names=["bucket", "filter", "least", "most"])

    now, parts, held = None, [], 0
    for batch in batches:
        buckets, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else []
        for a, b in zip(cuts, [*cuts[1:], len(buckets)]):
            if parts and (buckets[a] != now or held >= FILTER_KEYS):
                yield made(now, parts)
                parts, held = [], 0
            now, held = int(buckets[a]), held + int(b - a)
            parts.append(hashes[a:b])
    if parts:
        yield made(now, parts)


_ASKED = "hash long, generation string"


def _ask(_, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """(hash, generation) that a bucket's filters do not rule out."""
    hashes, out = asked["hash"].to_numpy(np.int64), []
    for generation, bits, least, most in zip(filters["generation"], filters["filter"],
                                             filters["least"], filters["most"]):
        near = hashes[(hashes >= least) & (hashes <= most)]
        hit = near[may_hold(bits, near)] if len(near) else near
        out.append(pd.DataFrame({"hash": hit, "generation": generation}))
    return pd.concat(out) if out else pd.DataFrame({"hash": [], "generation": []}).astype(
        {"hash": "int64", "generation": "str"})


class KeyIndex:
    """Landed keys under ``path``; see the module. ``opened`` counts the folders of keys the
    last batch read."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.opened = spark, path, buckets, 0

    def _alive(self, batch_id: int) -> list[tuple[str, int, int]]:
        at = f"{self.path}/manifest/batch_id={batch_id}"
        if batch_id < 0 or not path_exists(self.spark, at):
            return []
        return [tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(at).collect()]

    def _hashed(self, key: Column) -> list[Column]:
        hash_ = F.xxhash64(key)
        return [F.pmod(hash_, F.lit(self.buckets)).cast("int").alias("bucket"), hash_.alias("hash")]

    def _keys(self, generation: str) -> str:
        return f"{self.path}/keys/{generation}"

    def _write(self, keys: DataFrame, generation: str) -> int:
        """Writes (bucket, hash, key) as one generation with its filters; its number of keys."""
        by_bucket = keys.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "hash")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(self._keys(generation))
        written = self.spark.read.schema(keys.schema).parquet(self._keys(generation)).select(
            "bucket", "hash")
        n = written.count()
        filters = (written.repartition(self.buckets, "bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_filters, "bucket int, filter binary, least long, most long"))
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/{generation}")
        return n

    def unseen(self, rows: DataFrame, key: str, batch_id: int) -> DataFrame:
        """Rows whose key no earlier batch landed. Keys of ``rows`` are distinct."""
        alive, self.opened = self._alive(batch_id - 1), 0
        if not alive:
            return rows
        asked = materialize(rows.select(*self._hashed(F.col(key))).distinct(), "asked-keys")
        filters = None
        for generation, _, _ in alive:
            one = self.spark.read.parquet(f"{self.path}/filters/{generation}").withColumn(
                "generation", F.lit(generation))
            filters = one if filters is None else filters.unionByName(one)
        hits = materialize(asked.groupBy("bucket").cogroup(filters.groupBy("bucket"))
                           .applyInPandas(_ask, _ASKED), "asked-hits")
        pairs = hits.join(asked, "hash").select("generation", "bucket").distinct().collect()
        if not pairs:  # as many pairs as buckets times generations at most
            return rows
        self.opened = len(pairs)
        seen = None
        for generation in sorted({p["generation"] for p in pairs}):
            folders = [f"{self._keys(generation)}/bucket={p['bucket']}" for p in pairs
                       if p["generation"] == generation]
            one = self.spark.read.parquet(*folders).select("hash", F.col("key").alias("_seen"))
            seen = one if seen is None else seen.unionByName(one)
        return rows.withColumn("_hash", F.xxhash64(F.col(key))).join(
            seen.withColumnRenamed("hash", "_other"),
            (F.col("_hash") == F.col("_other")) & F.col(key).eqNullSafe(F.col("_seen")),
            "left_anti").drop("_hash")

    def add(self, rows: DataFrame, key: str, batch_id: int) -> None:
        """Adds the keys of ``rows`` as the generation of this batch and merges full levels."""
        alive = self._alive(batch_id - 1)
        name = f"b{batch_id}-l0"
        n = self._write(rows.select(*self._hashed(F.col(key)), F.col(key).alias("key")), name)
        if n:
            alive.append((name, 0, n))
        level = 0
        while len(full := [g for g in alive if g[1] == level]) >= FAN:
            together = None
            for generation, _, _ in full:
                one = self.spark.read.parquet(self._keys(generation)).select("bucket", "hash", "key")
                together = one if together is None else together.unionByName(one)
            name = f"b{batch_id}-l{level + 1}"
            alive = [g for g in alive if g[1] != level] + [
                (name, level + 1, self._write(together, name))]
            level += 1
        self.spark.createDataFrame(alive, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/batch_id={batch_id}")


def land_unique_indexed(stream: DataFrame, path: str, index: str, checkpoint: str,
                        key: str = "row_id", buckets: int = BUCKETS, available_now: bool = True,
                        watch=None) -> StreamingQuery:
    """Land each key once, however late it or its repeats arrive; ``jobs.land_unique`` with a
    cost per batch that follows the batch instead of everything landed.

    ``watch(batch_id, folders)`` is told how many folders of keys a batch opened.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        keys = KeyIndex(batch.sparkSession, index, buckets)
        fresh = materialize(keys.unseen(batch.dropDuplicates([key]), key, batch_id), "fresh-rows")
        write_batch(fresh, path, batch_id)
        keys.add(fresh, key, batch_id)
        if watch:
            watch(batch_id, keys.opened)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
