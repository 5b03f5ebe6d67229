"""Compression of vectors to short codes: four parts, a codebook of 256 entries for each.

Components become integers, so every sum is exact and a result does not depend on the layout.
The rows are stored once as blocks: each dimension of a block is a dictionary of its distinct
integers and a code per row. A pass over a block tabulates the squared difference of every
dictionary value to every codebook entry, and the distance of a part is the sum of the rows
gathered from those tables. Passes read the written blocks only, and each task returns one sum
per codebook entry, so neither memory nor what is exchanged grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 27       # integers are held within -LIMIT..LIMIT, so squared sums fit 64 bits
BLOCK_VALUES = 1 << 18  # components of a block: 4,096 rows of 64
_GATHER = 512         # rows whose distances are added up at once


def integers(vector) -> F.Column:
    """floor(SCALE * x) of each component, held within LIMIT."""
    held = lambda x: F.least(F.greatest(
        F.lit(float(SCALE)) * x.cast("double"), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def usable(vector) -> F.Column:
    """Whether a vector is there with components that are all finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (
        F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


_BLOCKS = ("vec_id array<bigint>, label array<{label}>, sizes array<int>, dictionary binary, "
           "codes binary")


def _encode(width: int, label: pa.DataType):
    """Blocks of the rows of a task, in the order they come."""
    rows_in = max(1, BLOCK_VALUES // max(1, width))

    def block(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        values, codes = [], np.empty(x.shape, dtype="<i4")
        for d in range(width):
            found, codes[:, d] = np.unique(x[:, d], return_inverse=True)
            values.append(found.astype("<i4"))
        wrap = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays(
            [wrap(ids), wrap(labels), wrap(pa.array([len(v) for v in values], pa.int32())),
             pa.array([np.concatenate(values).tobytes()]),
             pa.array([np.ascontiguousarray(codes.T).tobytes()])],
            names=["vec_id", "label", "sizes", "dictionary", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, width)
            for i in range(0, len(x), rows_in):
                n = min(rows_in, len(x) - i)
                yield block(batch.column(0).slice(i, n), batch.column(1).slice(i, n).cast(label),
                            x[i:i + n])
    return run


def _bounds(width: int) -> list[int]:
    return [p * width // PARTS for p in range(PARTS + 1)]


def _nearest(sizes: list[int], dictionary: bytes, codes: bytes, books: list[np.ndarray],
             ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(entries, distances) per part and row of a block, and the integers of each dimension."""
    values = np.split(np.frombuffer(dictionary, "<i4").astype(np.int64), np.cumsum(sizes)[:-1])
    at = np.frombuffer(codes, "<i4").reshape(len(sizes), -1)
    n, bounds = at.shape[1], _bounds(len(sizes))
    entry, distance = np.empty((PARTS, n), np.int64), np.empty((PARTS, n), np.int64)
    for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
        tables = [(values[d][:, None] - books[p][None, :, d - a]) ** 2 for d in range(a, b)]
        if sum(int(t.max()) for t in tables) < 1 << 31:
            tables = [t.astype(np.int32) for t in tables]  # half the memory to add up
        for i in range(0, n, _GATHER):
            rows = slice(i, min(n, i + _GATHER))
            total = np.zeros((rows.stop - i, len(books[p])), dtype=tables[0].dtype if tables else np.int64)
            for d, table in zip(range(a, b), tables):
                total += table[at[d, rows]]
            best = total.argmin(axis=1)  # the first of equals
            entry[p, rows] = best
            distance[p, rows] = total[np.arange(len(best)), best]
    return entry, distance, [v[c] for v, c in zip(values, at)]


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                   ("sums", pa.list_(pa.int64()))])


def _assign(books: list[np.ndarray]):
    """Counts and component sums per codebook entry, one row per entry and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                entry, _, x = _nearest(row["sizes"], row["dictionary"], row["codes"], books)
                bounds = _bounds(len(row["sizes"]))
                for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    counts[p] += np.bincount(entry[p], minlength=len(books[p]))
                    for d in range(a, b):
                        np.add.at(sums[p][:, d - a], entry[p], x[d])
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)),
                 pa.array(counts[p][used]), pa.array(sums[p][used].tolist(), pa.list_(pa.int64()))],
                schema=_SUMS)
    return run


def _updated(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks with every used entry at the floor of the mean of its parts."""
    each = blocks.select("sizes", "dictionary", "codes").mapInArrow(
        _assign(books), "part int, entry int, n long, sums array<bigint>")
    added = each.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy(
        "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [b.copy() for b in books]
    for r in added.collect():  # ENTRIES numbers per dimension at most
        new[r["part"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return new


def _codes(books: list[np.ndarray], label: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                entry, distance, _ = _nearest(row["sizes"], row["dictionary"], row["codes"], books)
                text = [e.tobytes().hex() for e in np.ascontiguousarray(entry.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["vec_id"], pa.int64()), batch.column(1)[k].values.cast(label),
                     pa.array(text), pa.array(distance.sum(axis=0))],
                    names=["vec_id", "label", "code", "error"])
    return run


def codebook_text(books: list[np.ndarray]) -> str:
    """All integers by part, entry and position, comma-joined."""
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def compress(vectors: DataFrame, vector: str = "embedding",
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks). codes: vec_id, label, code (two hex digits per part), error.

    Rows whose vector is null or empty, or holds a null, NaN or infinite component, are dropped,
    as are rows whose vector has another length than the one of the least vec_id. Lengths that
    four does not divide are cut at floor(p * length / 4). The codebooks start from the ENTRIES
    least vec_ids (nulls last, then by their integers; fewer rows, fewer entries). Repeated rows
    get a row each; a null vec_id or label stays as it is. Components beyond LIMIT / SCALE in
    size count as that. Other columns are not read. An empty table gives no rows and empty
    codebooks.
    """
    spark, kind = vectors.sparkSession, vectors.schema["label"].dataType
    kept = vectors.where(usable(F.col(vector))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col(vector)).alias("x"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        none = spark.createDataFrame([], f"vec_id long, label {kind.simpleString()}, "
                                         "code string, error long")
        return none, []
    width = len(first[0]["x"])
    kept = kept.where(F.size("x") == width)
    start = np.array([r["x"] for r in kept.orderBy(*order).limit(ENTRIES).collect()], np.int64)
    bounds = _bounds(width)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    arrow = _arrow_type(kind)
    blocks = materialize(kept.mapInArrow(_encode(width, arrow), _BLOCKS.format(
        label=kind.simpleString())), "vector-blocks")
    for _ in range(rounds):
        books = _updated(blocks, books)
    codes = blocks.mapInArrow(_codes(books, arrow), f"vec_id long, label {kind.simpleString()}, "
                                                    "code string, error long")
    return materialize(codes, "vector-codes"), books


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def code_report(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together) and the
    SHA-256 of the codebooks. Edge cases are those of ``compress``."""
    codes, books = compress(vectors, vector)
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    sums = materialize(codes.groupBy(F.col("label").alias("_label")).agg(
        F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same as DuckDB SQL, one pair of subqueries per round."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, unnest(range(64)) AS d, unnest(x) AS x FROM kept),
e0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS entry, x FROM
       (SELECT vec_id, x FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
b0 AS (SELECT entry, unnest(range(64)) AS d, unnest(x) AS x FROM e0)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS (SELECT vec_id, v.d // 16 AS part, entry, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS dist
       FROM v JOIN b{k} b ON v.d = b.d GROUP BY ALL),
a{k} AS (SELECT vec_id, part, min(dist) AS dist, min_by(entry, dist * {ENTRIES} + entry) AS entry
       FROM d{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
b{k + 1} AS (SELECT b.entry, b.d, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT a.entry, v.d, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS x
  FROM a{k} a JOIN v ON a.vec_id = v.vec_id AND v.d // 16 = a.part GROUP BY ALL) n
  ON n.entry = b.entry AND n.d = b.d)""")
    last = ROUNDS
    return ",".join(steps) + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
             CAST(sum(dist) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
l AS (SELECT c.*, kept.label FROM c JOIN kept USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d // 16, entry, d)) FROM b{last})
       AS codebooks_sha256
FROM l
"""
