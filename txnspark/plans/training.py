"""The training job: sample, encode, embed, compress, fit three heads, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators import encoders as E
from txnspark.operators import heads as H
from txnspark.operators import token_vectors as TV
from txnspark.operators import tokens as K
from txnspark.operators import vectors as V
from txnspark.operators.sampling import balanced_sample
from txnspark.session import materialize

HEAD_NAMES = ["raw", "embed", "combined"]
LEARNED = "learned"


@dataclass
class Bundle:
    """Everything fitted on train: dictionary, vocabulary, embedder, PCA and heads."""

    dictionary: DataFrame
    vocabulary: DataFrame
    embedder: V.Embedder
    pca: PipelineModel
    heads: dict[str, GBTClassificationModel] = field(default_factory=dict)
    extra_slots: bool = False

    def inputs(self, features: DataFrame, *keep: str) -> DataFrame:
        """(row_id, y, raw, pca): head inputs of any feature rows, in one narrow pass
        while dictionary and vocabulary are small enough to broadcast."""
        read = (embedded(features, self.vocabulary, self.embedder, self.extra_slots)
                if "embedding" in keep else encoded(features, self.vocabulary, self.extra_slots))
        d = E.with_raw_features(read, self.dictionary)
        pca = V.project_ids(self.embedder, self.pca, F.col("ids"))
        label = "y" if "y" in features.columns else F.lit(None).cast("int").alias("y")
        return d.select("row_id", label, *keep, "raw", pca.alias("pca"))

    def score(self, features: DataFrame, *keep: str) -> DataFrame:
        """One probability column per head; every head reads the same inputs."""
        return self.score_inputs(self.inputs(features, *keep), *keep)

    def score_inputs(self, inputs: DataFrame, *keep: str) -> DataFrame:
        out = inputs
        for name in HEAD_NAMES:
            model = self.heads[name]
            ready = out.withColumn("features", H.feature_vector(name))
            scored = model.transform(ready)
            out = scored.withColumn(f"p_{name}", H.vector_to_array("probability")[1]).drop(
                "features", "rawPrediction", "probability", "prediction")
        return out.select("row_id", "y", *keep, *[f"p_{n}" for n in HEAD_NAMES],
                          F.col("pca")[0].alias("x"), F.col("pca")[1].alias("y_pos"))

    def save(self, path: str) -> None:
        spark = self.dictionary.sparkSession
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.pca.write().overwrite().save(f"{path}/pca")
        for name, model in self.heads.items():
            model.write().overwrite().save(f"{path}/head_{name}")
        # Any embedder that can be sent to the workers can be stored the same way; one that
        # reads a table takes the table along.
        embedder = self.embedder
        if isinstance(embedder, TV.TokenVectors):
            embedder = embedder.stored(spark, f"{path}/token_vectors")
        spark.createDataFrame(
            [(bytearray(cloudpickle.dumps(embedder)), self.extra_slots)],
            "embedder binary, extra_slots boolean").write.mode("overwrite").parquet(
            f"{path}/embedder")

    @staticmethod
    def load(spark: SparkSession, path: str, embedder: V.Embedder | None = None) -> Bundle:
        """``embedder`` replaces the stored one. Load only bundles you trust: a stored
        embedder is code."""
        kept = spark.read.parquet(f"{path}/embedder").first()
        return Bundle(
            spark.read.parquet(f"{path}/dictionary"), spark.read.parquet(f"{path}/vocabulary"),
            embedder or cloudpickle.loads(bytes(kept["embedder"])),
            PipelineModel.load(f"{path}/pca"),
            {n: GBTClassificationModel.load(f"{path}/head_{n}") for n in HEAD_NAMES},
            kept["extra_slots"])


def long_scores(wide: DataFrame, *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("head"), F.col(f"p_{n}").alias("p"))
                      for n in HEAD_NAMES])
    return wide.select("row_id", "y", *keep, F.inline(pairs))


def token_slots(extra: bool) -> list[str]:
    return [*K.SLOTS, *K.EXTRA_SLOTS] if extra else K.SLOTS


def encoded(features: DataFrame, vocabulary: DataFrame, extra_slots: bool = False) -> DataFrame:
    return K.encode(K.with_slots(features, extra_slots), vocabulary, token_slots(extra_slots))


def embedded(features: DataFrame, vocabulary: DataFrame, embedder: V.Embedder,
             extra_slots: bool = False) -> DataFrame:
    return encoded(features, vocabulary, extra_slots).withColumn("embedding", V.embedding_column(embedder, F.col("ids")))


def select_rows(rows: DataFrame, budget: int | None) -> DataFrame:
    """Balanced train rows, or the whole split without a budget; all val and test rows.

    Only what a head is fitted on is bounded; curves and scores read every row.
    """
    if budget is None:
        return rows
    train = F.col("split") == "train"
    return balanced_sample(rows.where(train), budget, "balanced").unionByName(
        rows.where(F.col("split").isin("val", "test")))


@dataclass
class Training:
    bundle: Bundle
    rows: DataFrame
    inputs: DataFrame
    curves: DataFrame
    best_rounds: dict[str, int]
    scores: DataFrame


def train_heads(rows: DataFrame, budget: int | None, rounds: dict[str, int] | int,
                depth: int | None = None, components: int = S.PCA_DIM,
                patience: int = 20, dim: int = S.EMBED_DIM,
                embedder: V.Embedder | str | None = None,
                extra_slots: bool = False) -> Training:
    """``rows``: features with ``split``. Fits on train, stops on val, scores test.

    ``embedder`` replaces the built-in one, and ``LEARNED`` learns token vectors from the
    train rows; ``extra_slots`` adds the temporal and category
    tokens and needs ``ts`` and ``time_delta_s``.

    The selected rows, their ids and the head inputs are written once, embeddings never; the three fits and all
    reports read them.
    """
    chosen = materialize(select_rows(rows, budget), "selection")
    train = chosen.where(F.col("split") == "train")
    vocabulary = K.fit_vocabulary(K.with_slots(train, extra_slots), token_slots(extra_slots))
    dictionary = E.fit_dictionary(train)
    if embedder == LEARNED:
        embedder = TV.learn_embedder(K.encode(
            K.with_slots(train, extra_slots), vocabulary, token_slots(extra_slots)), dim)
    embedder = embedder or V.HashedProjection(vocabulary.count(), dim)
    # Boosting scans its rows hundreds of times: spread them once, in parts that fit a task.
    parts = H.fit_parts(chosen.count())
    with_ids = materialize(E.with_raw_features(
        encoded(chosen.repartition(parts, "row_id"), vocabulary, extra_slots), dictionary)
        .select("row_id", "y", "split", "raw", "ids"), "encoded")
    pca = V.fit_pca_of_ids(with_ids.where(F.col("split") == "train"), embedder, components)
    # Dealt and sorted once for all fits, while the rows are narrow, and kept on the executors'
    # disks until the heads are fitted.
    laid = H.laid_out(with_ids, parts).select(
        "row_id", "y", "split", "raw", V.project_ids(embedder, pca, F.col("ids")).alias("pca")
    ).persist(StorageLevel.DISK_ONLY)
    inputs = materialize(laid, "head-inputs")
    part = lambda s: inputs.where(F.col("split") == s)
    bundle = Bundle(dictionary, vocabulary, embedder, pca, extra_slots=extra_slots)
    curves, best = None, {}
    fitted_on = laid.where(F.col("split") == "train")
    for head in HEAD_NAMES:
        n = rounds if isinstance(rounds, int) else rounds[head]
        model, curve, best[head] = H.fit_with_early_stop(
            head, fitted_on, part("val"), n, depth or H.PARAMS[head].depth, patience, parts=None)
        bundle.heads[head] = model
        curve = curve.withColumn("head", F.lit(head))
        curves = curve if curves is None else curves.unionByName(curve)
    laid.unpersist()
    scores = materialize(long_scores(bundle.score_inputs(part("test"))), "test-scores")
    return Training(bundle, chosen, inputs, curves, best, scores)


def feature_names(components: int = S.PCA_DIM) -> list[str]:
    return [*E.raw_feature_names(), *[f"pca_{i}" for i in range(components)]]
