"""Boosted-tree heads: training, staged curves, early stop, scores, importances."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark.functions.features import logistic
from txnspark.operators.metrics import ranking_metrics
from txnspark.session import materialize, shared_root


@dataclass(frozen=True)
class HeadParams:
    rounds: int
    depth: int
    rate: float
    rows: float
    columns: float
    min_child: float


# --- fixed values: training parameters per head ---
PARAMS = {
    "raw": HeadParams(rounds=400, depth=8, rate=0.0023, rows=0.673, columns=0.95,
                      min_child=12),
    "embed": HeadParams(rounds=435, depth=12, rate=0.03774, rows=0.569, columns=0.587,
                        min_child=2.61),
    "combined": HeadParams(rounds=512, depth=12, rate=0.00305, rows=0.65, columns=0.768,
                           min_child=25.85),
}
SEED = 42
TOP_FEATURES = 15
CURVE_POINTS = 100
STOP_PATIENCE = 20
# --- end of fixed values ---

FIT_PARTS = 8
ROWS_PER_PART = 100_000  # about 200 MB of 512-d embeddings
FIRST_ROUNDS, MORE_ROUNDS = 60, 3  # rounds fitted first, and the factor when they do not stop
STAGE_TREES = 32  # trees whose columns one plan holds

INPUTS = {"raw": ["raw"], "embed": ["pca"], "combined": ["raw", "pca"]}


def feature_vector(head: str):
    """The head's input arrays side by side, as one vector column."""
    return array_to_vector(F.concat(*[F.col(c) for c in INPUTS[head]]))


def learner(head: str, rounds: int, depth: int) -> GBTClassifier:
    """Regularisation by leaf weight and split gain has no counterpart here; the
    minimum child weight becomes a row count."""
    p = PARAMS[head]
    return GBTClassifier(
        featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=p.rate,
        subsamplingRate=p.rows, featureSubsetStrategy=str(p.columns),
        minInstancesPerNode=math.ceil(p.min_child), seed=SEED, maxBins=64)


def with_features(df: DataFrame, head: str, *keep: str) -> DataFrame:
    return df.select("row_id", "y", *keep, feature_vector(head).alias("features"))


def fit_parts(rows: int) -> int:
    """Parts a fit reads: a function of the rows alone, never of the cluster."""
    return max(FIT_PARTS, rows // ROWS_PER_PART + 1)


def laid_out(train: DataFrame, parts: int = FIT_PARTS) -> DataFrame:
    """Rows in the parts and the order that fits read.

    The learner draws its row samples per part, in row order, so both are fixed here: the same
    rows give the same trees on any cluster.
    """
    return train.repartition(parts, "row_id").sortWithinPartitions("row_id")


def fit(head: str, train: DataFrame, rounds: int | None = None, depth: int | None = None,
        parts: int | None = FIT_PARTS) -> GBTClassificationModel:
    """``parts`` None: ``train`` is ``laid_out`` already. The learner asks for its rows more than
    once, so keep them when there are many."""
    p, sc = PARAMS[head], train.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        # Each round adds to the lineage of the errors, which a checkpoint cuts.
        sc.setCheckpointDir(shared_root(train.sparkSession))
    rows = with_features(train if parts is None else laid_out(train, parts), head)
    return learner(head, rounds or p.rounds, depth or p.depth).fit(rows)


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The same head with its first ``rounds`` trees only."""
    java, sc = model._java_obj, SparkContext._active_spark_context
    trees, weights = java.trees(), java.treeWeights()
    kept = sc._gateway.new_array(
        sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    share = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept[i], share[i] = trees[i], weights[i]
    return GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification
                                  .GBTClassificationModel(java.uid(), kept, share,
                                                          java.numFeatures(), java.numClasses()))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def running_totals(steps: pd.Series) -> pd.Series:
    return pd.Series([np.cumsum(s) for s in steps])


def staged_scores(model: GBTClassificationModel, rows: DataFrame, after: int = 0,
                  upto: int | None = None) -> DataFrame:
    """(round, row_id, y, p): the score after each boosting round, rounds from 1; only
    those above ``after`` up to ``upto`` if given."""
    d, margin = rows, F.lit(0.0)
    if after:
        before = first_trees(model, after).setRawPredictionCol("_before")
        d = before.setPredictionCol("").setProbabilityCol("").transform(rows)
        margin = vector_to_array("_before")[1]
    picked = list(zip(model.trees, model.treeWeights))[after:upto]
    for i, (tree, _) in enumerate(picked):
        d = tree.setPredictionCol(f"_t{i}").transform(d)
    steps = F.array(margin, *[F.lit(float(w)) * F.col(f"_t{i}") for i, (_, w) in enumerate(picked)])
    return d.select("row_id", "y", F.posexplode(running_totals(steps)).alias(
        "at", "margin")).where("at > 0").select(
        (F.col("at") + after).alias("round"), "row_id", "y",
        logistic(F.col("margin") * 2).alias("p"))


def eval_curve(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """(round, auc) on held-out rows, written, ``STAGE_TREES`` rounds at a time."""
    curve = None
    for after in range(0, len(model.treeWeights), STAGE_TREES):
        scores = staged_scores(model, rows, after, after + STAGE_TREES)
        part = materialize(ranking_metrics(scores, ["round"]).select("round", "auc"), "curve")
        curve = part if curve is None else curve.union(part)
    return curve


def early_stop(curve: DataFrame, by: list[str], patience: int = STOP_PATIENCE) -> DataFrame:
    """The last round trained when training stops after ``patience`` rounds without
    a strict improvement, and the best round up to there."""
    so_far = W.partitionBy(*by).orderBy("round")
    before = F.max("auc").over(so_far.rowsBetween(W.unboundedPreceding, -1))
    improved = F.col("auc") > before
    steps = curve.withColumn("_up", F.when(before.isNull() | improved, F.col("round")))
    steps = steps.withColumn("_last", F.max("_up").over(
        so_far.rowsBetween(W.unboundedPreceding, 0)))
    stop = steps.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("round") - F.col("_last") >= patience, F.col("round"))),
                   F.max("round")).alias("stop_round"))
    return steps.join(stop, by).where(F.col("round") == F.col("stop_round")).select(
        *by, "stop_round", F.col("_last").alias("best_round"))


def fit_with_early_stop(head: str, train: DataFrame, val: DataFrame, rounds: int, depth: int,
                        patience: int, parts: int | None = FIT_PARTS
                        ) -> tuple[GBTClassificationModel, DataFrame, int]:
    """(model, validation curve, best round).

    The learner's own early stop watches the loss and has no patience, so the curve
    is computed afterwards and the head is cut to the trees up to the best round. The first
    rounds of a longer fit are those of a shorter one, so ``rounds`` are fitted only where
    fewer do not stop; the curve ends where training stops.
    """
    tried = min(rounds, FIRST_ROUNDS)
    while True:
        model = fit(head, train, tried, depth, parts)
        curve = eval_curve(model, with_features(val, head))
        usable = curve.where(F.col("auc").isNotNull()).withColumn("head", F.lit(head))
        found = early_stop(usable, ["head"], patience).first()
        stopped = found is not None and found["stop_round"] - found["best_round"] >= patience
        if stopped or tried == rounds:
            break
        tried = min(rounds, tried * MORE_ROUNDS)
    if stopped:
        curve = curve.where(F.col("round") <= found["stop_round"])
    best = found["best_round"] if found else rounds
    if best < tried:
        model = first_trees(model, best)
    return model, curve, best


def score(model: GBTClassificationModel, df: DataFrame, head: str, *keep: str) -> DataFrame:
    """(row_id, y, head, p) with p the probability of fraud."""
    scored = model.transform(with_features(df, head, *keep))
    return scored.select("row_id", "y", *keep, F.lit(head).alias("head"),
                         vector_to_array("probability")[1].alias("p"))


def importances(model: GBTClassificationModel, names: list[str], n_raw: int,
                spark, top: int = TOP_FEATURES) -> DataFrame:
    """(name, importance, kind) of the ``top`` features; the first ``n_raw`` inputs are raw.

    As many rows as the head has inputs, so the vector is small.
    """
    shares = F.lit(np.round(model.featureImportances.toArray(), 5).tolist())
    inputs = spark.range(1).select(F.posexplode(F.arrays_zip(
        F.lit(names).alias("name"), shares.alias("importance"))).alias("at", "input"))
    kind = F.when(F.col("at") < n_raw, "raw").otherwise("embedding")
    return (inputs.select("input.name", "input.importance", kind.alias("kind"))
            .orderBy(F.desc("importance"), "name").limit(top))
