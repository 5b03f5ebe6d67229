"""Vectors: similarity, projections, pooling, embeddings and centred PCA."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.hashing import normal_number, uniform
from txnspark.operators.tokens import PAD_ID
from txnspark.session import path_exists

BATCH_ROWS = 512


def columns_to_vector(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def vector_to_columns(df: DataFrame, vector: str, n: int, prefix: str = "pca_") -> DataFrame:
    values = vector_to_array(F.col(vector))
    return df.select("*", *[values[i].alias(f"{prefix}{i}") for i in range(n)])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norm)


def euclidean(x0, y0, x1, y1) -> Column:
    return F.sqrt(F.pow(x0 - x1, 2) + F.pow(y0 - y1, 2))


def last_state(sequence) -> Column:
    return F.element_at(sequence, -1)


def mean_state(sequence, dim: int) -> Column:
    """Mean of the vectors of a sequence, within the row."""
    total = F.aggregate(sequence, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(
        s, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(sequence))


def linear_map(signals: list[Column], dim: int, salt: str = "projection",
               noise: float = 0.0, key: Column | None = None) -> Column:
    """``signals`` times a hash-generated matrix, as an array of ``dim`` doubles.

    With ``noise``, each component gets a normal number of that spread: four draws of the
    row's ``key`` step through the components. One matrix product per Arrow batch, so a
    signal's expression is evaluated once a row. A null signal makes all components null.
    """
    matrix = np.array([[normal_number(f"{i}.{j}", salt) for j in range(dim)]
                       for i in range(len(signals))])
    steps = np.arange(dim)

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        given = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
        out, parts = np.empty((len(given), dim)), max(1, len(given))
        for at in range(0, parts, BATCH_ROWS):
            x = given[at:at + BATCH_ROWS]
            mapped = sum(x[:, i, None] * row for i, row in enumerate(matrix))
            if noise:
                a, b, c, d = (x[:, len(matrix) + i, None] for i in range(4))
                r, t = a + steps * b, c + steps * d  # never negative
                mapped += noise * np.sqrt(-2.0 * np.log(1.0 - (r - np.floor(r)))) * np.cos(
                    2.0 * math.pi * (t - np.floor(t)))
            out[at:at + BATCH_ROWS] = mapped
        missing = np.zeros(len(given), bool)
        for column in columns:
            missing |= column.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(given) + 1, dtype=np.int32) * dim),
            pa.array(out.ravel(), mask=np.repeat(missing, dim)))

    draws = [uniform(key, f"{salt}.noise.{c}") for c in "abcd"] if noise else []
    return run(*[s.cast("double") for s in signals], *draws)


def component_sums(vector) -> Column:
    """A struct of a vector's length, sum, sum of squares and sum weighted by place (from 1)."""
    @F.arrow_udf("dims int, total double, energy double, weighted double")
    def run(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        sums = [np.bincount(row, v, len(lengths)) for v in (x, x * x, x * place)]
        none = np.isnan(sums[0]) & (vectors.flatten().null_count > 0)
        return pa.StructArray.from_arrays(
            [vectors.value_lengths(), *[pa.array(s, mask=none) for s in sums]],
            names=["dims", "total", "energy", "weighted"])

    return run(vector)


def sizes(vector) -> Column:
    """A struct of a vector's length, its sum of squares and the largest size of a component
    (NaN where one is, null where one is null). One pass over an Arrow batch, where lambdas over
    the array would be interpreted component by component."""
    @F.arrow_udf("dims int, energy double, largest double")
    def run(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(lengths)), lengths)
        largest, filled = np.zeros(len(lengths)), lengths > 0
        if len(x):
            largest[filled] = np.maximum.reduceat(
                np.abs(x), (np.cumsum(lengths) - lengths)[filled])
        none = vectors.is_null().to_numpy(zero_copy_only=False).copy()
        none[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        return pa.StructArray.from_arrays(
            [vectors.value_lengths(), pa.array(np.bincount(row, x * x, len(lengths)), mask=none),
             pa.array(largest, mask=none)], names=["dims", "energy", "largest"])

    return run(vector)


def mean_and_covariance(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(i, j, mean_i, mean_j, cov) for all i <= j: means and sample covariances.

    Each Arrow batch becomes one matrix product; a task sends one row per pair, whatever
    its number of rows.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float)
            if len(x):
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            i, j = np.triu_indices(len(total))
            columns = [i, j, np.full(len(i), n), total[i], total[j], products[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["i", "j", "n", "a", "b", "ab"])

    sums = (df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(
        partial, "i long, j long, n long, a double, b double, ab double")
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")]))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    return sums.select("i", "j", (a / n).alias("mean_i"), (b / n).alias("mean_j"),
                       F.try_divide(F.col("ab") - a * b / n, n - 1).alias("cov"))


class HashedProjection:
    """Built-in embedder: the mean of one pseudo-random vector per token.

    A vector is a function of token id and dimension only, so every worker builds
    the same table. Any callable with the same signature can replace it.
    """

    def __init__(self, vocabulary: int, dim: int = S.EMBED_DIM, seed: int = 42):
        self.vocabulary, self.dim, self.seed = vocabulary, dim, seed
        self._table = None

    def _vectors(self) -> np.ndarray:
        if self._table is None:
            rng = np.random.Generator(np.random.Philox(self.seed))
            table = rng.standard_normal((self.vocabulary, self.dim), dtype=np.float32)
            table[PAD_ID] = 0.0
            self._table = table
        return self._table

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        width = int((ids != PAD_ID).sum(axis=1).max(initial=1))
        ids = ids[:, :width]
        counts = np.maximum((ids != PAD_ID).sum(axis=1, keepdims=True), 1)
        out = np.zeros((len(ids), self.dim), dtype=np.float32)
        for column in ids.T:  # one gather per position keeps memory at rows x dim
            out += self._vectors()[column]
        return out / np.sqrt(counts, dtype=np.float32)


Embedder = Callable[[np.ndarray], np.ndarray]


def _id_matrix(ids: pa.Array) -> np.ndarray:
    """Id lists as one matrix, shorter lists padded at the end."""
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=1))
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(lengths), width), PAD_ID, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _embed_ids(embedder: Embedder, ids: pa.Array) -> pa.Array:
    """Vectors of one Arrow batch as an Arrow list array, ``BATCH_ROWS`` rows per call."""
    matrix = _id_matrix(ids)
    parts = [np.asarray(embedder(matrix[at:at + BATCH_ROWS]), dtype=np.float32)
             for at in range(0, len(matrix), BATCH_ROWS)]
    vectors = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vectors.reshape(-1)))


def embedding_column(embedder: Embedder, ids) -> Column:
    """The embedding of ``ids`` as a column; ``embedder`` maps an (n, length) int array
    to an (n, dim) float array and is shipped once per task.

    A column keeps the other fields of the row in the JVM, so nothing has to be
    joined back.
    """
    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _embed_ids(embedder, batch)

    return run(ids)


def embed(encoded: DataFrame, embedder: Embedder, key: str = "row_id",
          ids: str = "ids") -> DataFrame:
    """(key, embedding) of every row."""
    return encoded.select(key, embedding_column(embedder, F.col(ids)).alias("embedding"))


def embed_cached(encoded: DataFrame, embedder: Embedder, path: str,
                 key: str = "row_id") -> DataFrame:
    """Embeddings of every row of ``encoded``, computing only what ``path`` lacks.

    ``path`` should name the data version, the row budget and the split.
    """
    spark = encoded.sparkSession
    todo = encoded
    if path_exists(spark, path):
        todo = encoded.join(spark.read.parquet(path).select(key), key, "left_anti")
    embed(todo, embedder, key).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(encoded.select(key), key, "left_semi")


def fit_pca(train: DataFrame, k: int = S.PCA_DIM, embedding: str = "embedding") -> PipelineModel:
    """Centre and rotate; fitted on the given (train) rows only.

    Both stages reduce to dim-sized summaries by tree aggregation.
    """
    vectors = train.select(array_to_vector(F.col(embedding)).alias("_vec"))
    scaler = StandardScaler(inputCol="_vec", outputCol="_centred", withMean=True,
                            withStd=False).fit(vectors)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(scaler.transform(vectors))
    return PipelineModel([scaler, pca])


def ids_moments(train: DataFrame, embedder: Embedder, ids: str = "ids"
                ) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) of the embeddings of all rows of ``train``.

    Equal id lists are embedded once, with their number as weight, and no vector leaves its
    task: a task sends one matrix.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            matrix = _id_matrix(batch.column(0))
            weights = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
            for at in range(0, len(matrix), BATCH_ROWS):
                x = np.asarray(embedder(matrix[at:at + BATCH_ROWS]), dtype=float)
                weighted = x * weights[at:at + BATCH_ROWS]
                total, products = total + weighted.sum(axis=0), products + weighted.T @ x
            n += weights.sum()
        if n:
            rows = np.vstack([products, total, np.full(len(total), n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                names=["i", "x"])

    counted = train.groupBy(ids).agg(F.count(F.lit(1)).alias("n"))
    sums = counted.mapInArrow(partial, "i long, x array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("x")))).alias("x"))
    found = np.array([r["x"] for r in sums.orderBy("i").collect()])  # as many rows as dimensions
    n, total, products = found[-1, 0], found[-2], found[:-2]
    mean = total / n
    return int(n), mean, (products - n * np.outer(mean, mean)) / max(1.0, n - 1)


def fit_pca_of_ids(train: DataFrame, embedder: Embedder, k: int = S.PCA_DIM,
                   ids: str = "ids") -> PipelineModel:
    """``fit_pca`` of the embeddings of ``train``, which are neither written nor sent.

    The fit needs mean and covariance only, so it is given two points a dimension that have
    the same ones.
    """
    _, mean, covariance = ids_moments(train, embedder, ids)
    values, axes = np.linalg.eigh(covariance)
    reach = (axes * np.sqrt(np.maximum(values, 0) * (2 * len(mean) - 1) / 2)).T
    points = np.vstack([mean + reach, mean - reach])
    return fit_pca(train.sparkSession.createDataFrame(
        [(p.tolist(),) for p in points], "embedding array<double>"), k)


def project_ids(embedder: Embedder, model: PipelineModel, ids) -> Column:
    """The components of the embedding of ``ids``, as ``apply_pca`` gives them; the embedding
    stays in the task. Products have one shape, so a row's numbers do not hang on its batch."""
    mean = model.stages[0].mean.toArray()
    loadings = model.stages[1].pc.toArray() * np.array(component_signs(model))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            matrix, k = _id_matrix(batch), loadings.shape[1]
            out = np.empty((len(matrix), k))
            for at in range(0, len(matrix), BATCH_ROWS):
                x = np.asarray(embedder(matrix[at:at + BATCH_ROWS]), dtype=np.float32)
                centred = np.zeros((BATCH_ROWS, len(mean)))
                centred[:len(x)] = x - mean
                out[at:at + BATCH_ROWS] = (centred @ loadings)[:len(x)]
            offsets = np.arange(len(out) + 1, dtype=np.int32) * k
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))

    return run(ids)


def component_signs(model: PipelineModel) -> list[float]:
    """+1/-1 per component, so that its largest loading is positive."""
    loadings = model.stages[1].pc.toArray()
    biggest = np.abs(loadings).argmax(axis=0)
    return [1.0 if loadings[row, col] >= 0 else -1.0 for col, row in enumerate(biggest)]


def apply_pca(df: DataFrame, model: PipelineModel, out: str = "pca",
              embedding: str = "embedding") -> DataFrame:
    """Adds ``out``: the components as an array, with signs fixed."""
    signs = F.array(*[F.lit(s) for s in component_signs(model)])
    ready = df.withColumn("_vec", array_to_vector(F.col(embedding)))
    rotated = model.transform(ready)
    return (rotated.withColumn(out, F.zip_with(vector_to_array("_pca"), signs,
                                               lambda v, s: v * s))
            .drop("_vec", "_centred", "_pca"))


def explained_variance(model: PipelineModel) -> list[tuple[int, float, float]]:
    """(component, share, cumulative share)."""
    shares = model.stages[1].explainedVariance.toArray()
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares, shares.cumsum()))]


def mean_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    vector = array_to_vector(F.col(embedding))
    return df.select(vector.alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def map_points(pca: DataFrame, components: str = "pca") -> DataFrame:
    """2-D position: the first two components, the same rule for old and new rows."""
    return pca.withColumns({"x": F.col(components)[0], "y_pos": F.col(components)[1]})
