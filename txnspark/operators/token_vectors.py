"""Token vectors learned from which tokens occur together, and an embedder that reads them.

Three distributed steps: pairs of tokens within a window are counted, the counts become a
sparse table of positive pointwise mutual information, and block power iteration finds its
leading directions. A block is a table of one short vector per token; each step is one join of
pairs with vectors and one sum per token, and only matrices of ``token_dim`` squared numbers
reach the driver. The result is a table on the shared folder; workers read from it the vectors
of the ids they meet.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators.tokens import PAD_ID, SPECIALS
from txnspark.session import materialize, new_path

TOKEN_DIM = 64
WINDOW = 8
STEPS = 6
CACHED_VECTORS = 50_000


def _matrix(ids: pa.Array) -> np.ndarray:
    """Id lists as a matrix, cut after the longest list without its padding."""
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), int(lengths.max(initial=1))), PAD_ID, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :max(1, int((out != PAD_ID).sum(axis=1).max(initial=1)))]


def _pairs(window: int):
    """Counts per pair of ordinary ids (the lower first) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _matrix(batch.column(0)), []
            for gap in range(1, min(window, ids.shape[1] - 1) + 1):
                a, b = ids[:, :-gap].ravel(), ids[:, gap:].ravel()
                real = (a >= len(SPECIALS)) & (b >= len(SPECIALS))
                low, high = np.minimum(a, b)[real], np.maximum(a, b)[real]
                found.append(low << 32 | high)
            keys, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]),
                                return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))],
                names=["a", "b", "n"])
    return run


def cooccurrence(encoded: DataFrame, ids: str = "ids", window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two ordinary tokens stand within ``window`` places, both ways round.

    A pair of equal tokens counts twice, as the two ways do for others.
    """
    half = encoded.select(F.col(ids).cast("array<bigint>")).where(F.size(ids) > 0).mapInArrow(
        _pairs(window), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))
                  ).otherwise(F.array(F.struct("a", "b", "n"), F.struct(
                      F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return half.select(F.inline(both))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(a, b, weight): positive pointwise mutual information in nats, zeros left out."""
    pairs = materialize(pairs, "token-pairs")
    single = materialize(pairs.groupBy(F.col("a").alias("_t")).agg(F.sum("n").alias("_n")),
                         "token-totals")
    total = single.agg(F.sum("_n")).scalar()
    left = single.select(F.col("_t").alias("_ta"), F.col("_n").alias("_na"))
    right = single.select(F.col("_t").alias("_tb"), F.col("_n").alias("_nb"))
    weight = F.log(F.col("n").cast("double") * total / (F.col("_na").cast("double") * F.col("_nb")))
    return (pairs.join(left, F.col("a") == F.col("_ta")).join(right, F.col("b") == F.col("_tb"))
            .select("a", "b", weight.alias("weight")).where("weight > 0"))


def _start(dim: int):
    """A pseudo-random vector per token, a function of its id alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy().astype(np.uint64)
                x = ids[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64) + np.uint64(1)
                for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
                x ^= x >> np.uint64(31)
                yield _rows(batch.column(0), x.astype(np.float64) / 2.0 ** 63 - 1)
    return run


def _rows(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))],
        names=["id", "vector"])


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_VECTORS = "id long, vector array<double>"


def _times(weights: DataFrame, block: DataFrame) -> DataFrame:
    """(id, vector): the weights times a block of vectors."""
    other = block.select(F.col("id").alias("_b"), array_to_vector("vector").alias("_v"))
    summed = weights.join(other, F.col("b") == F.col("_b")).groupBy(F.col("a").alias("id")).agg(
        Summarizer.sum(F.col("_v"), F.col("weight")).alias("_s"))
    return summed.select("id", vector_to_array("_s").alias("vector"))


def _gram(block: DataFrame, dim: int) -> np.ndarray:
    """Inner products of the columns of a block; dim squared sums from each task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _dense(batch.column(0), dim)
            total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])],
                                         names=["i", "j", "v"])
    sums = block.select("vector").mapInArrow(partial, "i long, j long, v double").groupBy(
        "i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dim, dim))
    for r in sums:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _mapped(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column(0), _dense(batch.column(1), len(matrix)) @ matrix)
    return block.mapInArrow(run, _VECTORS)


def learn_vectors(weights: DataFrame, dim: int = TOKEN_DIM, steps: int = STEPS) -> DataFrame:
    """(id, vector): leading singular directions of a symmetric table of weights, each scaled
    by the root of its singular value. Directions the table does not have are zero."""
    weights = materialize(weights, "token-weights")
    block = weights.select(F.col("a").alias("id")).distinct().mapInArrow(_start(dim), _VECTORS)
    block = materialize(block, "token-block")
    for step in range(steps + 1):
        block = materialize(_times(weights, block), "token-block")
        values, turn = np.linalg.eigh(_gram(block, dim))
        values, turn = values[::-1], turn[:, ::-1]
        live = values > max(values[0], 0) * 1e-18
        # Orthonormal columns between the steps, roots of the singular values at the end.
        power = -0.5 if step < steps else -0.25
        scale = np.where(live, np.where(live, values, 1.0) ** power, 0.0)
        turn = turn * np.sign(turn[np.abs(turn).argmax(axis=0), np.arange(dim)])
        block = _mapped(block, turn * scale)
    return block


class TokenVectors:
    """Embedder over a written table of token vectors, sensitive to the order of tokens.

    The place of a token picks the block of the embedding its vector is added to, so the same
    tokens in another order embed differently. Vectors are read by the distinct ids of a batch;
    at most ``CACHED_VECTORS`` stay with a worker. Ids without a vector add nothing.
    """

    def __init__(self, path: str, token_dim: int = TOKEN_DIM, dim: int = S.EMBED_DIM):
        self.path, self.token_dim, self.dim = path, token_dim, dim
        self.places = max(1, dim // token_dim)
        self._known: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _read(self, ids: list[int]) -> None:
        uri = self.path if "://" in self.path or not self.path.startswith("file:") else (
            "file://" + self.path[len("file:"):])
        system, path = (fs.FileSystem.from_uri(uri) if "://" in uri
                        else (fs.LocalFileSystem(), uri))
        table = pads.dataset(path, filesystem=system, format="parquet").to_table(
            filter=pads.field("id").isin(ids))
        self._known.update(dict.fromkeys(ids))
        x = _dense(table.column("vector").combine_chunks(), self.token_dim).astype(np.float32)
        self._known.update(zip(table.column("id").to_pylist(), x))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """One row per id, zeros for an unknown one."""
        new = [i for i in ids.tolist() if i not in self._known]
        if new:
            if len(self._known) + len(new) > CACHED_VECTORS:
                self._known = {}
                new = ids.tolist()
            self._read(new)
        none = np.zeros(self.token_dim, dtype=np.float32)
        found = [self._known[i] for i in ids.tolist()]
        return np.stack([none if v is None else v for v in found])

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(ids, return_inverse=True)
        at, table = at.reshape(ids.shape), self.vectors(distinct)
        width = int((ids != PAD_ID).sum(axis=1).max(initial=1))
        out = np.zeros((len(ids), self.places, self.token_dim), dtype=np.float32)
        for place in range(width):
            out[:, place % self.places] += table[at[:, place]]
        flat = out.reshape(len(ids), -1)
        return np.pad(flat, ((0, 0), (0, self.dim - flat.shape[1])))

    def stored(self, spark: SparkSession, path: str) -> TokenVectors:
        """A copy whose table lies at ``path``, such as in a saved bundle."""
        spark.read.parquet(self.path).write.mode("overwrite").parquet(path)
        moved = copy.copy(self)
        moved.path, moved._known = path, {}
        return moved


def learn_embedder(encoded: DataFrame, dim: int = S.EMBED_DIM, token_dim: int = TOKEN_DIM,
                   window: int = WINDOW, steps: int = STEPS, ids: str = "ids") -> TokenVectors:
    """An embedder learned from the id lists of ``encoded``, all of them."""
    spark = encoded.sparkSession
    vectors = learn_vectors(mutual_information(cooccurrence(encoded, ids, window)),
                            token_dim, steps)
    path = new_path(spark, "token-vectors")
    # Files of neighbouring ids, so a lookup opens those it needs.
    vectors.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return TokenVectors(path, token_dim, dim)
