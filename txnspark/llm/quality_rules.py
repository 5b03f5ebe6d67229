"""Quality rules: fixed limits, then robust multivariate outliers.

DataFrame functions only. Text statistics are transformed to four numbers of comparable
scale. Per language and source, a minimum-covariance-determinant estimate (C-steps on the
three quarters of rows nearest to the centre, then one reweighting) gives a centre and
covariance that junk can't pull; rows beyond a Mahalanobis distance are rejected.

The numbers are kept in whole thousandths, so all sums are exact and the verdicts are the
same under any layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import SPACES, let, row_key, text_of, without, words_of
from txnspark.session import materialize

MIN_WORDS = 50
WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("x_length", "x_symbols", "x_lines", "x_repeats")
UNIT = 1000.0  # features are stored in thousandths
MIN_GROUP = 200
LANGUAGE, ALL = -1, -2  # levels of rows that fall back to their whole language, or to all rows
KEEP_SHARE = 0.75
STEPS = 8
# The spread below which differences say nothing about quality, per feature: a tenth in the
# length of words, a symbol in twenty words, one line or window in fifty.
LEAST_SPREAD = (0.10, 0.05, 0.15, 0.15)
_BINS_PER_LOG = 8


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row_key, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_lines, n_repeat_words, base_failed) of each row; a null text has no words.

    Repeated windows: each 3-word window as a 64-bit hash with its position, sorted, and
    compared with its neighbours; the covered positions are then counted in one pass.
    """
    body = text_of(text)
    d = docs.select("doc_id", "lang", "source", row_key(docs).alias("row_key"),
                    body.alias("_body"))
    lines = F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = (d.withColumn("_words", words_of(F.col("_body"))).withColumn("_lines", lines)
         .withColumn("_n", F.size("_words")))
    ordered = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.col("_n") - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]).alias("h"),
            i.alias("i"))))
    d = d.withColumn("_windows", F.when(F.col("_n") >= WINDOW, ordered))
    near = lambda i: F.get(F.col("_windows"), i)["h"]
    hits = F.filter("_windows", lambda x, i: near(i - 1).eqNullSafe(x["h"])
                    | near(i + 1).eqNullSafe(x["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(hits, lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")))["n"]
    d = d.select(
        "doc_id", "row_key", "lang", "source", F.col("_n").cast("long").alias("n_words"),
        (F.length("_body") - F.regexp_count("_body", F.lit(SPACES))).cast("long")
        .alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        .alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def feature_columns() -> list[Column]:
    """The transformed statistics in thousandths: length of words and symbols per word on a
    log scale, square roots (near-even spread) of the shares of repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    values = (F.log1p(F.col("word_chars") / n), F.log1p(F.col("n_symbols") / n),
              F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(v * UNIT).cast("long").alias(c) for c, v in zip(FEATURES, values)]


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def _chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, df) < p else (low, mid)
    return low


# Squared distance a clean Gaussian vector exceeds in one case of 1,000: 18.47. Each feature
# alone can exceed it, for LEAST_SPREAD: 42 % of lines or words repeated, 0.24 symbols a word.
CUTOFF = _chi2_quantile(0.999, len(FEATURES))


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of Gaussian rows unbiased."""
    p = len(FEATURES)
    return share / _chi2_cdf(_chi2_quantile(share, p), p + 2)


def _moment_sums() -> list[Column]:
    sums = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(FEATURES):
        sums.append(F.sum(a).alias(f"s{i}"))
        sums += [F.sum(F.col(a) * F.col(b)).alias(f"s{i}{j}")
                 for j, b in enumerate(FEATURES[:i + 1])]
    return sums


_SUMS = ["n"] + [c for i in range(len(FEATURES)) for c in
                 (f"s{i}", *(f"s{i}{j}" for j in range(i + 1)))]


def _append(values: Column, entry) -> Column:
    """``values`` with one more number, computed from those there (each evaluated once)."""
    return let(values, lambda v: F.concat(v, F.array(entry(v))))


def _inverse_factor(factor: float) -> list[Column]:
    """m0.. and v00..: centre and inverse Cholesky factor of the covariance, from sums.

    The least spread joins each variance, so a feature that never varies (or a cell of
    copies) stays invertible.
    """
    n, p = F.col("n").cast("double"), len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    at = {("c", *ij): k for k, ij in enumerate(pairs)}
    cov = []
    for i, j in pairs:
        c = (F.col(f"s{i}{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)) * factor
        cov.append(F.greatest(c, F.lit(0.0)) + (LEAST_SPREAD[i] * UNIT) ** 2 if i == j else c)
    values = F.array(*cov)

    def factor_entry(i: int, j: int):
        def entry(v: Column) -> Column:
            rest = F.get(v, at["c", i, j])
            for k in range(j):
                rest = rest - F.get(v, at["l", i, k]) * F.get(v, at["l", j, k])
            return F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.get(
                v, at["l", j, j])
        return entry

    def inverse_entry(i: int, j: int):
        def entry(v: Column) -> Column:
            total = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                total = total - F.get(v, at["l", i, k]) * F.get(v, at["v", k, j])
            return total / F.get(v, at["l", i, i])
        return entry

    for kind, make in (("l", factor_entry), ("v", inverse_entry)):
        for i, j in pairs:
            at[kind, i, j] = len(at)
            values = _append(values, make(i, j))
    return [*[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(p)],
            F.slice(values, 2 * len(pairs) + 1, len(pairs)).alias("v")]


def _estimates(sums: DataFrame, cell: list[str], factor: list[Column]) -> DataFrame:
    return materialize(sums.select(*cell, *factor), "mcd-estimates")


def _distance(rows: DataFrame, estimates: DataFrame, cell: list[str]) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance d2 (null in cells without estimate)."""
    right = estimates.select(*[F.col(c).alias(f"_e_{c}") for c in cell],
                             *[c for c in estimates.columns if c not in cell])
    same = None
    for c in cell:
        eq = F.col(c).eqNullSafe(F.col(f"_e_{c}"))
        same = eq if same is None else same & eq
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.get("v", i * (i + 1) // 2 + j) * (F.col(FEATURES[j]) - F.col(f"m{j}"))
        total = total + F.pow(z, 2)
    return rows.join(right, same, "left").withColumn("d2", total).drop(*right.columns)


def _nearest(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Sums over the rows of each cell nearest to its centre, three quarters of them.

    Rows are counted by distance bins (an eighth of a log unit), and all bins up to the
    one that reaches the share are taken: one aggregation with a partial step, whose
    result is a few hundred rows per cell.
    """
    step = F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-9))) * _BINS_PER_LOG)
    bins = (rows.withColumn("_bin", F.least(F.lit(200), step)).groupBy(*cell, "_bin")
            .agg(*_moment_sums()))
    upto = W.partitionBy(*cell).orderBy("_bin")
    before = F.coalesce(F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.sum("n").over(W.partitionBy(*cell)) * F.lit(KEEP_SHARE)
    return (bins.withColumn("_before", before).withColumn("_wanted", wanted)
            .where(F.col("_before") < F.col("_wanted"))
            .groupBy(*cell).agg(*[F.sum(c).alias(c) for c in _SUMS]))


def _same(a: DataFrame, b: DataFrame) -> bool:
    mark = lambda d: d.select(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()[0]
    return mark(a) == mark(b)


def covariance_estimates(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each cell, from all its rows.

    Starts around the componentwise medians; a C-step takes the nearest three quarters and
    estimates anew. Ends when no cell changes, or after ``STEPS`` steps.
    """
    # Exact: a cell has a few thousand different values (thousandths) at most.
    medians = materialize(rows.groupBy(*cell).agg(*[
        F.percentile(x, 0.5).alias(f"m{i}") for i, x in enumerate(FEATURES)]), "medians")
    d = rows.join(
        medians.select(*[F.col(c).alias(f"_e_{c}") for c in cell],
                       *[f"m{i}" for i in range(len(FEATURES))]),
        [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in cell])
    scaled = F.lit(0.0)
    for i, x in enumerate(FEATURES):
        scaled = scaled + F.pow((F.col(x) - F.col(f"m{i}")) / (LEAST_SPREAD[i] * UNIT), 2)
    sums = materialize(_nearest(d.withColumn("d2", scaled), cell), "mcd-start")
    raw = _inverse_factor(_consistency(KEEP_SHARE))
    for _ in range(STEPS):
        estimates = _estimates(sums, cell, raw)
        now = materialize(_nearest(_distance(rows, estimates, cell), cell), "mcd-step")
        if _same(now, sums):
            break
        sums = now
    share = 0.975
    inside = _distance(rows, _estimates(sums, cell, raw), cell).where(
        F.col("d2") <= _chi2_quantile(share, len(FEATURES)))
    final = materialize(inside.groupBy(*cell).agg(*_moment_sums()), "mcd-final")
    return _estimates(final, cell, _inverse_factor(_consistency(share)))


def quality_verdicts(docs: DataFrame, text: str = "text", min_group: int | None = None,
                     cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs``: statistics, base_failed, d2 and kept.

    Rows failing the fixed limits (fewer than 50 words, or over half of them in repeated
    windows) are rejected and take no part in the estimates. A language and source with
    fewer than 200 other rows is estimated with the like sources of its language, and those
    with all such rows; with still fewer, by the whole language (large cells included) or, if
    that has under 200 rows too, by all rows, however few. So every row that passes the limits
    has a distance. A ``min_group`` that is given is strict instead: it replaces the 200, and
    rows without an estimate of that size have no distance and are kept. Null languages and sources are groups like any other. An empty table gives an empty
    result.
    """
    stats = materialize(text_statistics(docs, text).select("*", *feature_columns()),
                        "text-statistics")
    strict, min_group = min_group is not None, min_group or MIN_GROUP
    rows = stats.where(~F.col("base_failed"))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = F.sum(F.when(F.col("n") < min_group, F.col("n")).otherwise(0))
    sizes = (sizes.withColumn("in_lang", rest.over(W.partitionBy("lang")))
             .withColumn("level", F.when(F.col("n") >= min_group, 2)
                         .when(F.col("in_lang") >= min_group, 1).otherwise(0)))
    alone = F.sum(F.when(F.col("level") == 0, F.col("n")).otherwise(0)).over(W.partitionBy())
    whole = F.sum("n").over(W.partitionBy("lang"))
    last = F.lit(None) if strict else F.when(whole >= min_group, LANGUAGE).otherwise(ALL)
    sizes = sizes.withColumn("alone", alone).withColumn("cell_level", F.when(
        (F.col("level") > 0) | (F.col("alone") >= min_group), F.col("level")).otherwise(last))
    # The estimates a row takes part in: its own, and those of rows that fall back.
    asked = lambda level, over: F.max(
        F.col("cell_level").eqNullSafe(level)).over(over)
    place = lambda level, lang, source: F.struct(
        level.cast("int").alias("cell_level"), lang.cast("string").alias("cell_lang"),
        source.cast("string").alias("cell_source"))
    none = F.lit(None)
    own = place(F.col("cell_level"),
                F.when(F.col("cell_level").isin(1, 2, LANGUAGE), F.col("lang")),
                F.when(F.col("cell_level") == 2, F.col("source")))
    sizes = materialize(sizes.select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), own.alias("_own"),
        F.array_distinct(F.filter(F.array(
            own,
            F.when(asked(LANGUAGE, W.partitionBy("lang")),
                   place(F.lit(LANGUAGE), F.col("lang"), none)),
            F.when(asked(ALL, W.partitionBy()), place(F.lit(ALL), none, none))),
            lambda c: c["cell_level"].isNotNull())).alias("_cells")), "cells")
    placed = stats.join(
        sizes, F.col("lang").eqNullSafe(F.col("_lang"))
        & F.col("source").eqNullSafe(F.col("_source")) & ~F.col("base_failed"), "left")
    cell = ["cell_level", "cell_lang", "cell_source"]
    vectors = materialize(placed.select(F.explode("_cells").alias("_cell"), *FEATURES)
                          .select("_cell.*", *FEATURES), "vectors")
    placed = placed.select("*", "_own.*").drop("_lang", "_source", "_own", "_cells")
    measured = _distance(placed, covariance_estimates(vectors, cell), cell)
    return (measured.withColumn("kept", ~F.col("base_failed") & (
        F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).drop(*cell, *FEATURES))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows the quality rules reject."""
    verdicts = quality_verdicts(docs)
    return without(docs, materialize(
        verdicts.where(~F.col("kept")).select("doc_id", "row_key"), "rejected"))
