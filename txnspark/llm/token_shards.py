"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

The documents of a scan partition form one stream of ids, cut into sequences of equal
length. With N sequences in all, a Feistel network under a key permutes 0..N-1 (values
outside are walked along their cycle until they fall inside), which gives each sequence its
global slot without a sort or a table. Slot ranges are the shards: one task writes one
shard, in order, each sequence at (slot mod size) times the stride. A reader finds any slot
by arithmetic and reads on from there.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import text_of
from txnspark.llm.tokens import default_tokenizer, tokenizer
from txnspark.session import materialize, new_path

LENGTH = 2048
END_ID = 1
KEY = 20_240_229
ROUNDS = 6
LEAST_SHARD = 512  # sequences
MOST_SHARDS = 1 << 16


def _round(value: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix (multiply and shift)."""
    x = (value + np.uint64(key & (2 ** 64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The place of each index in a keyed permutation of 0..n-1."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for r in order:
                if inverse:
                    left, right = right ^ (_round(left, key * 31 + r) & mask), left
                else:
                    left, right = right, left ^ (_round(right, key * 31 + r) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, total = tokenizer(path), None, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            total += batch.num_rows + sum(tok.counts(batch.column(1)))
        rows = [] if part is None else [(part, total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())],
            names=["part", "tokens"])
    return run


def _sequences(path: str, length: int, end_id: int, dtype: str, total: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base, most, at = tokenizer(path), 0, 0, 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        size = 0

        def record(rows: list[tuple]) -> pa.RecordBatch:
            if any(r[0] >= most for r in rows):
                raise ValueError("the scan partitions changed between the passes")
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            columns[0] = permute(base + np.array(columns[0], dtype=np.int64), total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["slot", "ids", "n_ids", "doc_ids"])

        rows: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                base, most = batch.column(2)[0].as_py(), batch.column(3)[0].as_py()
            for doc_id, own in zip(batch.column(0).to_pylist(), tok.each(batch.column(1))):
                all_ids = np.append(own, np.uint32(end_id)).astype(dtype)
                while len(all_ids):
                    piece, all_ids = all_ids[:length - size], all_ids[length - size:]
                    held.append(piece)
                    docs.append(doc_id)
                    size += len(piece)
                    if size == length:
                        rows.append((at, np.concatenate(held).tobytes(), size, docs))
                        held, docs, size, at = [], [], 0, at + 1
                        if len(rows) >= 256:
                            yield record(rows)
                            rows = []
        if size:
            held.append(np.full(length - size, end_id, dtype=dtype))
            rows.append((at, np.concatenate(held).tobytes(), size, docs))
        yield record(rows)
    return run


def _writer(root: str, shard_sequences: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(root)
        # A shard appears under its name only when whole; a repeated task writes the same
        # bytes, so it does not matter whose file stays.
        own, stream, shard = f"{folder}/.{uuid.uuid4().hex}", None, None

        def close():
            stream.close()
            fs.move(own, f"{folder}/shard-{shard:06d}.bin")

        for batch in batches:
            names = batch.schema.names
            slots = batch.column(names.index("slot")).to_pylist()
            ids = batch.column(names.index("ids")).to_pylist()
            for slot, raw in zip(slots, ids):
                if slot // shard_sequences != shard:
                    if stream:
                        close()
                    shard, stream = slot // shard_sequences, fs.open_output_stream(own)
                stream.write(raw)
            crc = [zlib.crc32(raw) for raw in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("slot")),
                 pa.array([s // shard_sequences for s in slots], pa.int32()),
                 pa.array([s % shard_sequences * stride for s in slots], pa.int64()),
                 batch.column(names.index("n_ids")), pa.array(crc, pa.int64()),
                 batch.column(names.index("doc_ids"))],
                names=["slot", "shard", "byte_offset", "n_ids", "ids_crc32", "doc_ids"])
        if stream:
            close()
    return run


def write_shards(docs: DataFrame, root: str | None = None, length: int = LENGTH,
                 end_id: int = END_ID, key: int = KEY, tokenizer_path: str | None = None,
                 text: str = "text") -> tuple[DataFrame, str]:
    """Writes all documents as token shards under ``root``; (manifest, root).

    The manifest has one row per sequence: slot, shard, byte_offset, n_ids (the rest of the
    stride is padded with the end id), ids_crc32 (of the whole stride) and doc_ids (of the
    documents it has ids of, in order). ``root`` must be a folder all executors reach by
    a scheme that pyarrow knows; the default lies in the shared folder. Ids are unsigned
    16-bit little-endian, or 32-bit for larger vocabularies. A shard has at least 512
    sequences, more where there would be over 65,536 shards.

    Two passes over the texts, the first only counts; ids are shuffled once and never
    stored between. A null or empty text is its end id. Repeated rows are written each.
    Other columns are not read. An empty table writes a description and no shard.
    """
    spark, path = docs.sparkSession, tokenizer_path or default_tokenizer()
    root = root or new_path(spark, "token-shards")
    dtype = "<u2" if tokenizer(path).size <= 1 << 16 else "<u4"
    stride = length * np.dtype(dtype).itemsize
    given = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text"),
                        F.spark_partition_id().alias("part"))
    parts = materialize(given.mapInArrow(_counts(path), "part int, tokens long"), "token-counts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("n", F.ceil(F.col("tokens") / F.lit(length)))
    bases = materialize(parts.select(  # one row per scan partition
        F.col("part").alias("_part"), F.col("n").alias("_n"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "token-bases")
    total = bases.agg(F.sum("_n")).first()[0] or 0
    shard_sequences = max(LEAST_SHARD, math.ceil(total / MOST_SHARDS))
    shards = max(1, math.ceil(total / shard_sequences))

    from pyarrow.fs import FileSystem
    fs, folder = FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    # One row per scan partition, so the bases stay small however long the texts are.
    numbered = given.join(F.broadcast(bases), F.col("part") == F.col("_part"))
    rows = numbered.select("doc_id", "text", "_base", "_n").mapInArrow(
        _sequences(path, length, end_id, dtype, total, key),
        "slot long, ids binary, n_ids long, doc_ids array<long>")
    ordered = rows.repartitionById(
        shards, F.floor(F.col("slot") / shard_sequences).cast("int")).sortWithinPartitions("slot")
    manifest = materialize(ordered.mapInArrow(
        _writer(root, shard_sequences, stride),
        "slot long, shard int, byte_offset long, n_ids long, ids_crc32 long, doc_ids array<long>"),
        "token-manifest")
    about = {"sequences": total, "shards": shards if total else 0, "key": key,
             "shard_sequences": shard_sequences, "length": length, "dtype": dtype,
             "stride": stride, "end_id": end_id}
    with fs.open_output_stream(f"{folder}/shards.json") as out:
        out.write(json.dumps(about).encode())
    return manifest, root


def read_slots(root: str, first: int, count: int) -> np.ndarray:
    """``count`` sequences from slot ``first`` on, in training order; (count, length) ids."""
    from pyarrow.fs import FileSystem

    fs, folder = FileSystem.from_uri(root)
    with fs.open_input_file(f"{folder}/shards.json") as file:
        about = json.loads(file.read())
    size, stride, out = about["shard_sequences"], about["stride"], []
    last = min(first + count, about["sequences"])
    while first < last:
        shard, at = divmod(first, size)
        n = min(last - first, size - at)
        with fs.open_input_file(f"{folder}/shard-{shard:06d}.bin") as file:
            file.seek(at * stride)
            out.append(np.frombuffer(file.read(n * stride), dtype=about["dtype"]))
        first += n
    flat = np.concatenate(out) if out else np.zeros(0, dtype=about["dtype"])
    return flat.reshape(-1, about["length"])
