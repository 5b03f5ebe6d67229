"""Repeatable samples by hash of the row key.

Exact-size samples never sort the table: the draws are written once beside their
keys, histograms narrow them down to the last wanted row, and the sample is then a
plain filter of the table on the draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.hashing import uniform
from txnspark.operators.ordered import (CELLS, EDGE_ROWS, range_with_position, ranged,
                                        rows_at)
from txnspark.session import materialize


def bernoulli_sample(df: DataFrame, rate, salt: str, key: str = "row_id") -> DataFrame:
    """Keep each row with probability ``rate``; 1 or more keeps all."""
    return df.where(uniform(key, salt) < rate)


def keep_positives(df: DataFrame, rate, salt: str, label: str = "y",
                   key: str = "row_id") -> DataFrame:
    """All positives, and negatives at ``rate``."""
    return df.where((F.col(label) == 1) | (uniform(key, salt) < rate))


def sample_splits(df: DataFrame, plan: DataFrame, salt: str = "ingest") -> DataFrame:
    """Train keeps all positives and thins negatives to its cap; val and test are
    thinned at their natural rate. One pass over the table."""
    keep = plan.select(F.struct("keep_train", "keep_val", "keep_test")).scalar()
    draw, split = uniform("row_id", salt), F.col("split")
    return df.where(
        F.when(split == "train", (F.col("y") == 1) | (draw < keep["keep_train"]))
        .when(split == "val", draw < keep["keep_val"])
        .when(split == "test", draw < keep["keep_test"]))


def _take_smallest(df: DataFrame, quota, salt: str, stratum: Column, key: str,
                   bins: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Rows with the smallest draws of each stratum; quota: {stratum: rows} -> {stratum: wanted}.

    Equal draws are taken in the order of the (unique) key. A row without stratum or key is
    never taken.
    """
    draw = uniform(key, salt)
    draws = materialize(
        df.select(stratum.alias("_s"), draw.alias("_u"), F.col(key).alias("_k"))
        .where(F.col("_s").isNotNull() & F.col("_u").isNotNull()), "draws")
    within = F.lit(False)
    for last in rows_at(draws, quota, bins, edge_rows):
        at, k = F.lit(last["_u"]), F.lit(last["_k"]).cast(df.schema[key].dataType)
        within = within | ((stratum == F.lit(last["_s"])) & (
            (draw < at) | ((draw == at) & (F.col(key) <= k))))
    return df.where(within)


def exact_sample(df: DataFrame, n: int, salt: str, key: str = "row_id",
                 bins: int = CELLS) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows when there are fewer."""
    return _take_smallest(df, lambda sizes: {s: min(n, rows) for s, rows in sizes.items()},
                          salt, F.lit(0), key, bins)


def first_rows(df: DataFrame, n: int, key: str = "row_id", ranges: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest (unique) keys.

    Counts per key range find the range of the last wanted row, that range alone is
    ranked, and the result is a filter on the key; no task merges everyone's rows.
    """
    placed = ranged(df.select(key), [key], ranges)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    edge = range_with_position(counts, [], F.lit(n - 1)).select(  # one row
        F.col("_range").alias("_at"), "_skip")
    rank = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    last = (placed.join(F.broadcast(edge), F.col("_range") == F.col("_at"))
            .withColumn("_r", rank).where(F.col("_r") == F.col("_skip"))
            .agg(F.max(key)).scalar())
    return df.where(F.lit(n > 0) & F.coalesce(F.col(key) <= last, F.lit(True)))


def balanced_sample(df: DataFrame, budget: int, salt: str, label: str = "y",
                    positive_share: float = 0.1, key: str = "row_id",
                    bins: int = CELLS) -> DataFrame:
    """``budget`` rows, a tenth of them positive as far as the classes reach."""
    def quota(sizes):
        ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
        target = min(budget, ones + zeros)
        taken = min(ones, math.floor(target * positive_share))
        return {1: taken, 0: min(zeros, target - taken)}
    return _take_smallest(df, quota, salt, F.col(label), key, bins)


def natural_sample(df: DataFrame, split: str, budget: int) -> DataFrame:
    """Evaluation sample at the natural positive rate, with a salt per split."""
    return exact_sample(df, budget, f"natural.{split}")


def map_sample(df: DataFrame, budget: int = S.MAP_ROWS) -> DataFrame:
    return exact_sample(df, budget, "map")
