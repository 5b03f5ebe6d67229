"""One governed training run: budget by run number, training, record in the history."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators import encoders as E
from txnspark.operators import external as U
from txnspark.operators import external_fit as UF
from txnspark.operators import heads as H
from txnspark.operators import metrics as M
from txnspark.operators.ordered import thin_positions
from txnspark.plans import runs as R
from txnspark.plans import training as T
from txnspark.sources import documents


def next_run(spark: SparkSession, history_path: str) -> int:
    history = documents.run_history(spark, history_path)
    return history.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]


def with_external_head(scores: DataFrame, test: DataFrame, scorer: U.FrameScorer,
                       columns: list[str]) -> DataFrame:
    """Adds the external scorer as a head; rows it could not score carry a NULL."""
    external = U.external_scores(test, scorer, columns).join(test.select("row_id", "y"), "row_id")
    return scores.select("row_id", "y", "head", "p").unionByName(external.select(
        "row_id", "y", F.lit("external").alias("head"), F.col("score").alias("p")))


def _models(metrics: DataFrame):
    summary = M.head_summary(metrics)
    return summary.agg(F.array_sort(F.collect_list(
        F.struct("key", "label", "test_auc", "test_ap", "stub")))).scalar()


def _lift(metrics: DataFrame):
    pick = lambda h, c: F.max(F.when(F.col("head") == h, F.col(f"{c}_lift_pct")))
    return M.lift(metrics).agg(F.struct(*[
        pick(h, c).alias(f"{h}_{c}_pct")
        for h in ("embed", "combined") for c in ("auc", "ap")])).scalar()


def _curves(training: T.Training):
    """Per head: at most 100 rounds with their validation AUC, and the best round."""
    last = training.curves.groupBy("head").agg(F.max("round").alias("n"))
    points = training.curves.join(last, "head").withColumn("pos", F.col("round") - 1)
    thin = thin_positions(points, "pos", F.col("n"), H.CURVE_POINTS)
    best = F.create_map(*[F.lit(x) for kv in training.best_rounds.items() for x in kv])
    one = thin.groupBy("head").agg(F.array_sort(F.collect_list(
        F.struct("round", F.round("auc", 5).alias("auc")))).alias("c"))
    entry = F.struct("head", F.struct(
        F.col("c.round").alias("rounds"), F.col("c.auc").alias("auc"),
        best[F.col("head")].alias("best_round")).alias("curve"))
    return one.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def run_record(training: T.Training, scores: DataFrame, run: int, started: datetime,
               seconds: float, components: int = S.PCA_DIM) -> DataFrame:
    """The nested record of one run, as a one-row table."""
    spark = scores.sparkSession
    metrics = M.ranking_metrics(scores, ["head"])
    combined = scores.where(F.col("head") == "combined")
    separation = M.score_histogram(combined).agg(F.array_sort(F.collect_list(
        F.struct("bin", "legit", "fraud")))).scalar()
    top = H.importances(training.bundle.heads["combined"], T.feature_names(components),
                        len(E.raw_feature_names()), spark)
    importance = top.agg(F.collect_list(F.struct("name", "importance", "kind"))).scalar()
    finished = datetime.now(timezone.utc)
    has_external = ~scores.where(F.col("head") == "external").agg(
        F.count(F.lit(1)) == 0).scalar()
    return spark.range(1).select(
        F.lit(run).alias("run"),
        F.lit(f"r{run}-{finished:%Y%m%dT%H%M%S}").alias("run_id"),
        F.lit(started.isoformat(timespec="seconds")).alias("started_at"),
        F.lit(finished.isoformat(timespec="seconds")).alias("finished_at"),
        F.lit(round(seconds, 1)).alias("duration_sec"),
        R.budget(F.lit(run)).alias("budget"), _models(metrics).alias("models"),
        _lift(metrics).alias("lift"), has_external.alias("external"),
        R.empty_registry().alias("registry"),
        F.struct(separation.alias("separation"), importance.alias("importance"),
                 _curves(training).alias("curves")).alias("diagnostics"))


def training_run(rows: DataFrame, history_path: str, bundle_path: str | None = None,
                 scorer: U.FrameScorer | None = None, scorer_columns: list[str] | None = None,
                 rounds: dict[str, int] | int | None = None, depth: int | None = None,
                 components: int = S.PCA_DIM, learner: UF.Learner | None = None,
                 **training_options) -> T.Training:
    """Grant the next budget, train, save the bundle and append the run record.

    ``rows`` are features with their split. ``rounds`` and ``depth`` override the
    budget's boosting rounds and the heads' depths. ``learner`` is fitted on raw train rows and
    its scorer becomes the external head; without a model the run goes on without that head.
    """
    spark, started, clock = rows.sparkSession, datetime.now(timezone.utc), time.perf_counter()
    run = next_run(spark, history_path)
    budget = spark.range(1).select(R.budget(F.lit(run)).alias("b")).first()["b"]
    training = T.train_heads(rows, budget["embed_max"],
                             rounds or budget["n_estimators"].asDict(), depth,
                             components=components, **training_options)
    scores = training.scores
    if learner is not None:
        part = lambda split: training.rows.where(F.col("split") == split)
        scorer = UF.fit_external(part("train"), part("val"), part("test"), learner,
                                 scorer_columns).scorer
    if scorer is not None:
        test = training.rows.where(F.col("split") == "test")
        scores = with_external_head(scores, test, scorer, scorer_columns or S.RAW_VIEW)
    if bundle_path:
        training.bundle.save(bundle_path)
    documents.append_runs(
        run_record(training, scores, run, started, time.perf_counter() - clock, components),
        history_path)
    return training
