"""Inputs shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.functions.features import with_basic_features
from txnspark.functions.rules import rule_scores
from txnspark.operators.heads import fit_parts
from txnspark.operators.metrics import ranking_metrics
from txnspark.operators.splits import split_plan, with_split
from txnspark.plans import runs
from txnspark.session import materialize
from txnspark.sources.transactions import from_events, load_transactions, read_table


_built: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """One build per session and input folder, for state many queries read."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def features(spark: SparkSession, folder: str) -> DataFrame:
    return with_basic_features(load_transactions(spark, folder))


def dealt_features(spark: SparkSession, folder: str) -> DataFrame:
    """``features`` for jobs that work much on each row: events are dealt by key while they are
    raw, because a table of few row groups is read by as few tasks."""
    events = read_table(spark, folder, "events")
    return with_basic_features(from_events(
        events.repartition(fit_parts(events.count()), "event_id")))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, y, d, head, p) of the four rule heads on every transaction."""
    return rule_scores(features(spark, folder), "d")


def split_features(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Every transaction with features and its temporal split, nothing sampled; ``dealt``
    as in ``dealt_features``."""
    feats = features(spark, folder)
    return with_split(dealt_features(spark, folder) if dealt else feats, split_plan(feats))


def test_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(split_features(spark, folder).where(F.col("split") == "test"), "d")


def value_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A model-free score with many distinct values: the event value ranks errors."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(F.col("event_id").alias("row_id"),
                         (F.col("event_type") == "error").cast("int").alias("y"),
                         F.lit("value").alias("head"), F.col("value").alias("p"))


def line_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One score per order line: the price ranks returned lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                        F.lit("price").alias("head"), F.col("l_extendedprice").alias("p"))


def daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """AUC and AP per (d, head): each day's transactions scored by every head."""
    return once(spark, folder, "daily-metrics", lambda: materialize(
        ranking_metrics(scores(spark, folder), ["d", "head"]), "daily-metrics"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """A run history: one training-and-evaluation record per day of transactions."""
    def build():
        days = (features(spark, folder).groupBy("d").agg(F.count(F.lit(1)).alias("rows")))
        return materialize(
            runs.records(daily_metrics(spark, folder), days), "history")
    return once(spark, folder, "history", build)


def rounds_curve(spark: SparkSession, folder: str) -> DataFrame:
    """(model, round, auc): long metric curves, one point per order date and priority."""
    orders = read_table(spark, folder, "orders")
    curve = orders.groupBy(F.col("o_orderpriority").alias("model"), "o_orderdate").agg(
        F.round(F.avg("o_totalprice") / 500000, 9).alias("auc"))
    rounds = F.row_number().over(W.partitionBy("model").orderBy("o_orderdate"))
    return curve.select("model", rounds.alias("round"), "auc")
