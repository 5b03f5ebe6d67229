"""Quality classifier by Bradley-Terry ranking of text statistics.

Every labelled row outside the held-out part is learned from. Rows are dealt into buckets of
about ``BUCKET`` rows; in a bucket each good text meets bad ones and each bad text good ones. A
pass over the buckets sums gradient and curvature of the pairs, and Newton steps on these small
sums find the weights. Bucket sums are rounded to whole steps, so no layout changes a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from txnspark.llm.common import text_of
from txnspark.operators.quantiles import exact_quantiles
from txnspark.session import materialize

BUCKET = 512
MATES = 4  # rows of the other class that a row of the larger class meets
LEAST = 32  # rows of the smaller class a bucket should hold
STEPS = 12
DECAY = 1e-4
UNIT = 2.0 ** 24  # sums are added as whole multiples of its inverse
THRESHOLD = 0.7
HELD_OUT = 2  # the remainder of crc32(doc_id) modulo 4 that is never learned from
_CASE = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>^~=_\\{}[]@"


def _statistics(text: str) -> list[float]:
    """Numbers of a whole text; a text without words gives the same fixed vector."""
    raw = text.encode("utf-8", "surrogatepass")
    words, size = raw.split(), max(1, len(raw))
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    different = len(set(words))
    twins = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    length = sum(map(len, words)) / n
    share = lambda x: math.log(x + 1e-3)
    return [
        math.log(n), math.log(length), share(count(_SYMBOLS) / size), share(count(_CASE) / size),
        share(count(b"!") / size), share(count(b"?") / size), share(count(b".") / size),
        share(count(b",") / size), share(count(b"0123456789") / size), share(count(b"|") / size),
        share(1 - len({*lines}) / len(lines)), share(twins / n), different / n,
        math.log(different) / math.log(n + 1), 1 - pairs / max(1, n - 1),
        share(len(max(words, key=len)) / size), share(len(lines) / n)]


N_STATISTICS = 17


def _expand(x: np.ndarray) -> np.ndarray:
    """The statistics, their squares, and their products with the length of the text."""
    return np.concatenate([x, x * x, x * x[:, :1]], axis=1)


@pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([_statistics(t or "") for t in texts])


def crc_part(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


class BradleyTerry:
    """Scores whose differences give the odds that one text is preferred to another."""

    def __init__(self) -> None:
        self.mean, self.spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        self.weights, self.cut, self.scale = np.zeros(3 * N_STATISTICS), 0.0, 1.0

    def expanded(self, x: np.ndarray) -> np.ndarray:
        return _expand(self._standard(x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.expanded(x) * self.weights).sum(axis=1)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1), growing with preference; the threshold quantile is at 0.7."""
        raw = self.raw(x)
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.scale + shift, -30, 30)))


def _buckets(marked: DataFrame) -> tuple[DataFrame, float]:
    """((bucket, y, own, x) with one row per bucket, share of bad rows). Each bucket holds its
    rows in order; the smaller class is dealt into several buckets, as ``own`` in its first."""
    n = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return marked.limit(0), 0.0
    buckets = max(1, (good + bad) // BUCKET)
    copies = min(buckets, max(1, math.ceil(LEAST * buckets / min(good, bad))))
    small = F.col("quality") == F.lit(0 if bad < good else 1)
    turn = F.explode(F.sequence(F.lit(0), F.when(small, copies - 1).otherwise(0)))
    dealt = marked.select("*", turn.alias("turn")).withColumn("bucket", F.pmod(
        F.xxhash64("doc_id") + F.col("turn"), F.lit(buckets)))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "turn", "quality", "x")))
    packed = dealt.groupBy("bucket").agg(rows.alias("rows")).select(
        "bucket", F.col("rows.quality").alias("y"),
        F.transform("rows", lambda r: r["turn"] == 0).alias("own"), F.flatten("rows.x").alias("x"))
    return materialize(packed, "quality-buckets"), bad / (good + bad)


def _sum(buckets: DataFrame, part: Callable, size: int) -> np.ndarray:
    """The sum over all buckets of ``part(bucket, y, own, x)``, an array of ``size`` numbers."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for frame in frames:
            for number, y, own, x in zip(frame["bucket"], frame["y"], frame["own"], frame["x"]):
                x = np.asarray(x).reshape(-1, N_STATISTICS)
                total += np.rint(part(number, np.asarray(y), np.asarray(own, bool), x)
                                 * UNIT).astype(np.int64)
        yield pd.DataFrame({"at": np.arange(size), "total": total})

    sums = (buckets.mapInPandas(run, "at int, total long").groupBy("at")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total")).collect())
    out = np.zeros(size)
    for r in sums:  # one row per number
        out[r["at"]] = r["total"]
    return out / UNIT


def _pairs(number: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of preferred and other rows: all rows of a bucket, mixed by its number."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    draw, n = np.random.default_rng(7 + int(number)), MATES * max(len(good), len(bad))
    mixed = lambda rows: np.concatenate(
        [draw.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    return mixed(good), mixed(bad)


def fit(marked: DataFrame) -> BradleyTerry:
    """Of every row (doc_id, quality, x); without both labels all scores are the threshold."""
    model, size = BradleyTerry(), 3 * N_STATISTICS
    buckets, share = _buckets(marked)
    if not share:
        return model

    def moments(number, y, own, x):
        x = x[own]
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = _sum(buckets, moments, 1 + 2 * N_STATISTICS)
    model.mean = sums[1:1 + N_STATISTICS] / sums[0]
    squares = sums[1 + N_STATISTICS:] / sums[0]
    model.spread = np.sqrt(np.maximum(squares - model.mean ** 2, 0)) + 1e-6
    upper = np.triu_indices(size)

    def slope(number, y, own, x):
        a, b = _pairs(number, y)
        z = model.expanded(x)
        d = z[a] - z[b]
        p = 1 / (1 + np.exp(np.clip(d @ model.weights, -40, 40)))  # of the wrong order
        loss = np.logaddexp(0, -(d @ model.weights)).sum()
        curve = (d * (p * (1 - p))[:, None]).T @ d
        return np.concatenate([[len(d), loss], (p[:, None] * d).sum(axis=0), curve[upper]])

    kept, step, best = model.weights, np.zeros(size), np.inf
    for _ in range(STEPS):
        sums = _sum(buckets, slope, 2 + size + len(upper[0]))
        n, w = max(1.0, sums[0]), model.weights
        loss = sums[1] / n + DECAY / 2 * float(w @ w)
        if loss > best:  # too far: half the way
            step = step / 2
            model.weights = kept + step
            continue
        done = best - loss < 1e-7
        kept, best = w, loss
        if done:
            break
        gradient = sums[2:2 + size] / n - DECAY * w
        curve = np.zeros((size, size))
        curve[upper] = sums[2 + size:] / n
        curve = curve + np.triu(curve, 1).T + DECAY * np.eye(size)
        step = np.linalg.solve(curve, gradient)
        model.weights = kept + step
    model.weights = kept

    @pandas_udf(T.DoubleType())
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(x.to_list()).reshape(-1, N_STATISTICS)))

    # The threshold is the quantile of the scores that as many texts lie below as are bad;
    # halfway between neighbours, so it does not hang on one text.
    scores = materialize(marked.select(raw("x").alias("raw")), "quality-raw")
    edges = exact_quantiles(scores, "raw", [min(1.0, max(0.0, share + e)) for e in (-0.01, 0.01)])
    model.cut = float(np.mean([r["value"] for r in edges.orderBy("i").collect()]))

    def scatter(number, y, own, x):
        r = model.raw(x[own]) - model.cut
        return np.array([len(r), r.sum(), (r * r).sum()])

    n, total, squares = _sum(buckets, scatter, 3)
    model.scale = max(1e-6, math.sqrt(max(0.0, squares / n - (total / n) ** 2)) / 4)
    return model


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x) of every row, computed once for learning and scoring."""
    return materialize(docs.select("doc_id", statistics(text_of(text)).alias("x")), "text-statistics")


def learn(numbers: DataFrame, labels: DataFrame, rows: int | None = None) -> BradleyTerry:
    """Learns from every labelled row that is not held out, or from the ``rows`` of them with the
    least hash.

    Rows whose crc32(doc_id) modulo 4 is 2 are held out. A document with several labels
    counts with the lowest.
    """
    marked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                           & (crc_part(F.col("doc_id")) != HELD_OUT))
              .groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("quality")))
    if rows is not None:
        marked = marked.orderBy(F.xxhash64("_doc"), "_doc").limit(rows)
    # Only numbers of a text are sent, never the text.
    sample = (numbers.join(marked, F.col("doc_id") == F.col("_doc"))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")))
    return fit(materialize(sample, "quality-sample"))


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None,
          text: str = "text") -> BradleyTerry:
    return learn(text_statistics(docs, text), labels, rows)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int | None = None,
                   text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score in (0, 1), predicted.

    Only the text enters a score. A null text counts as empty; texts without words share
    a score. Repeated rows get a row each. Other columns are not read. An empty table
    gives an empty result, an empty label table the score 0.7 throughout.
    """
    numbers = text_statistics(docs, text)
    model = learn(numbers, labels, rows)

    @pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.to_list()).reshape(-1, N_STATISTICS)))

    scored = numbers.select("doc_id", (crc_part(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                            score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
