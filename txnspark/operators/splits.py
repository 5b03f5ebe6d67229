"""Leakage-free temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S


def date_counts(df: DataFrame, date: str = "d") -> DataFrame:
    """Rows per date: partial counts per task, so one heavy date is no hot spot."""
    return df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))


def split_plan(df: DataFrame, date: str = "d", train_cap: int = S.TRAIN_CAP,
               eval_rows: int | None = None) -> DataFrame:
    """One row: cut-off dates, rows per split and the sampling rates.

    Windows run over one row per calendar date only. Rows without a date are in no
    split and not in the total. Validation and test keep every row unless ``eval_rows``
    asks for a thinner sample.
    """
    everything = W.partitionBy()
    running = W.orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    c = date_counts(df.where(F.col(date).isNotNull()), date).select(
        F.col(date).alias("d"), "n",
        F.sum("n").over(running).alias("cum"), F.sum("n").over(everything).alias("total"))
    train_share, eval_share = F.lit(S.TRAIN_RATIO), F.lit(S.TRAIN_RATIO + S.VAL_RATIO)
    c = c.withColumns({
        "train_cut": F.min(F.when(F.col("cum") >= train_share * F.col("total"), F.col("d")))
        .over(everything),
        "test_cut": F.min(F.when(F.col("cum") >= eval_share * F.col("total"), F.col("d")))
        .over(everything),
    })
    in_train, in_test = F.col("d") < F.col("train_cut"), F.col("d") >= F.col("test_cut")
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    sums = c.agg(
        F.first("train_cut").alias("train_cut"), F.first("test_cut").alias("test_cut"),
        F.first("total").alias("total"), rows(in_train).alias("n_train"),
        rows(~in_train & ~in_test).alias("n_val"), rows(in_test).alias("n_test"))
    rate = lambda cap, n: F.least(
        F.lit(1.0), F.lit(float(cap)) / F.greatest(F.lit(1), F.col(n)))
    return sums.withColumns({
        "keep_train": rate(train_cap, "n_train"),
        "keep_val": rate(eval_rows, "n_val") if eval_rows else F.lit(1.0),
        "keep_test": rate(eval_rows, "n_test") if eval_rows else F.lit(1.0),
    })


def with_split(df: DataFrame, plan: DataFrame, date: str = "d") -> DataFrame:
    """Adds ``split`` (NULL without a date); the plan is one row and reaches the tasks as a
    constant."""
    cut = plan.select(F.struct("train_cut", "test_cut")).scalar()
    d = F.col(date)
    return df.withColumn("split", F.when(d < cut["train_cut"], "train")
                         .when(d < cut["test_cut"], "val").when(d.isNotNull(), "test"))


def fraud_rate(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               (F.avg(F.col("y").cast("double")) * 100).alias("fraud_pct"))
