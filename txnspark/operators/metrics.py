"""Exact ranking metrics and score diagnostics on long-form scores.

A score table has ``y`` (0/1), ``p`` and any grouping columns (usually ``head``).
Rows are grouped by score first, so ties are exact and the ordered scan sees one
row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators.ordered import prefix_sum, thin_positions
from txnspark.session import materialize

HISTOGRAM_BINS = 30


def by_threshold(scores: DataFrame, group_by: list[str], ranges: int | None = None,
                 staged: bool = True) -> DataFrame:
    """Per distinct score, highest first: its counts and the running counts.

    ``staged`` writes the counts per score to the shared folder first: the ordered
    scan reads them more than once, the scoring plan behind them runs only once.
    """
    grouped = (scores.where(F.col("p").isNotNull())
               .groupBy(*group_by, "p")
               .agg(F.sum("y").cast("bigint").alias("pos"),
                    F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
               .withColumn("_down", -F.col("p")))
    if staged:
        grouped = materialize(grouped, "score-counts")
    ranked = prefix_sum(grouped.withColumn("_one", F.lit(1).cast("bigint")), ["_down"],
                        {"cum_pos": "pos", "cum_neg": "neg", "rank": "_one"}, group_by, ranges)
    return ranked.drop("_down", "_one")


def ranking_metrics(scores: DataFrame, group_by: list[str],
                    ranges: int | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per group, in one scan."""
    t = by_threshold(scores, group_by, ranges)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    n_pos, n_neg = F.sum(pos), F.sum(neg)
    return t.groupBy(*group_by).agg(
        F.try_divide(F.sum(neg * (cum_pos - pos / 2)), n_pos * n_neg).alias("auc"),
        F.try_divide(F.sum(pos * (cum_pos / (cum_pos + cum_neg))), n_pos).alias("ap"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def curve(scores: DataFrame, ranges: int | None = None) -> DataFrame:
    """Precision, recall (true-positive rate) and false-positive rate per threshold."""
    t = by_threshold(scores, ["head"], ranges)
    # The last threshold of a head holds its totals: one row per head.
    totals = t.groupBy("head").agg(
        F.max("cum_pos").cast("double").alias("_p"), F.max("cum_neg").cast("double").alias("_n"),
        F.max("rank").alias("thresholds"))
    return t.join(F.broadcast(totals), "head").select(
        "head", "p", "cum_pos", "cum_neg", "rank", "thresholds",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("_p")).alias("recall"),
        F.try_divide(F.col("cum_neg"), F.col("_n")).alias("fpr"))


def thinned_curve(scores: DataFrame, points: int = 100) -> DataFrame:
    """The curve at no more than ``points`` evenly spaced thresholds per head."""
    c = curve(scores).withColumn("pos", F.col("rank") - 1)
    return thin_positions(c, "pos", F.col("thresholds"), points).drop("rank", "thresholds")


def histogram_bin(p, bins: int = HISTOGRAM_BINS):
    """Bin i holds edge(i) <= p < edge(i+1), edge(i) = i/bins; the last bin is closed.

    The product p*bins can round across an edge, so the guess is checked against
    the edges themselves.
    """
    width = F.lit(1.0 / bins)
    guess = F.least(F.floor(p * bins), F.lit(bins - 1))
    return (F.when(p < guess * width, guess - 1)
            .when((p >= (guess + 1) * width) & (guess < bins - 1), guess + 1)
            .otherwise(guess)).cast("int")


def score_histogram(scores: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Legit and fraud counts per bin on [0, 1]; empty bins included."""
    hits = (scores.where(F.col("p").between(0.0, 1.0))
            .groupBy(histogram_bin(F.col("p"), bins).alias("bin"))
            .agg(F.sum(1 - F.col("y")).alias("legit"), F.sum("y").alias("fraud")))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(hits, "bin", "left").select(
        "bin", F.round(F.col("bin") / bins, 3).alias("left_edge"),
        F.round((F.col("bin") + 1) / bins, 3).alias("right_edge"), zero("legit"), zero("fraud"))


def normalised_histogram(histogram: DataFrame) -> DataFrame:
    """Bin midpoint and each count as a percentage of its own class."""
    n = histogram.agg(F.struct(F.sum("legit").alias("legit"), F.sum("fraud").alias("fraud"))
                      ).scalar()
    share = lambda c: (F.col(c) / F.greatest(n[c], F.lit(1)) * 100).alias(f"{c}_pct")
    return histogram.select("bin", ((F.col("left_edge") + F.col("right_edge")) / 2).alias("mid"),
                            share("legit"), share("fraud"))


def confusion(scores: DataFrame, threshold: float = S.FLAG_THRESHOLD,
              group_by: tuple[str, ...] = ("head",)) -> DataFrame:
    flagged, y = F.col("p") >= F.lit(threshold), F.col("y")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counts = scores.groupBy(*group_by).agg(
        count(flagged & (y == 1)).alias("tp"), count(flagged & (y == 0)).alias("fp"),
        count(~flagged & (y == 1)).alias("fn"), count(~flagged & (y == 0)).alias("tn"))
    return counts.withColumns({
        "precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")),
    })


def head_summary(metrics: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per head with its label, rounded metrics and the stub flag."""
    labels = F.create_map(*[F.lit(x) for kv in S.HEAD_LABELS.items() for x in kv])
    return metrics.select(
        *keep, F.col("head").alias("key"), labels[F.col("head")].alias("label"),
        F.round("auc", 4).alias("test_auc"), F.round("ap", 4).alias("test_ap"),
        (F.col("head") == "external").alias("stub"))


def lift(metrics: DataFrame, baseline: str = "raw",
         group_by: tuple[str, ...] = ()) -> DataFrame:
    """Percent change of AUC and AP against the baseline head; NULL on a zero base.

    ``metrics`` has one row per head, so the window holds a handful of rows.
    """
    heads = W.partitionBy(*group_by)
    out = []
    for c in ("auc", "ap"):
        base = F.max(F.when(F.col("head") == baseline, F.col(c))).over(heads)
        out.append(F.round(F.try_divide(F.col(c) - base, base) * 100, 2).alias(f"{c}_lift_pct"))
    return metrics.select(*metrics.columns, *out)


def map_extent(points: DataFrame, padding: float = 0.08) -> DataFrame:
    """Padded bounding box of map points; a zero width counts as 1."""
    box = points.agg(*[f(c).alias(f"{c}{n}") for c in ("x", "y")
                       for n, f in (("min", F.min), ("max", F.max))])
    out = []
    for c in ("x", "y"):
        low, high = F.col(f"{c}min"), F.col(f"{c}max")
        pad = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)) * F.lit(padding)
        out += [(low - pad).alias(f"{c}_low"), (high + pad).alias(f"{c}_high")]
    return box.select(*out)
