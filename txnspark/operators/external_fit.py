"""The fit side of an external scorer: a user's callable learns from raw rows in one task.

The learner sees a bounded, repeatable sample of untransformed rows in a seeded order, runs in a
barrier stage under a deadline, and hands back a scorer of raw frames. Whatever happens, the
result is a row: status, sizes, seconds and the metrics on the whole test split.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators.external import SCORE_TIMEOUT_S, TRAIN_ROWS, FrameScorer, external_scores
from txnspark.operators.metrics import ranking_metrics
from txnspark.operators.sampling import exact_sample
from txnspark.session import materialize

FIT_TIMEOUT_S = 600.0

Frames = list[pd.DataFrame]
Learner = Callable[[Frames, Frames], FrameScorer]  # (train, validation), each with ``y``

_FITTED = "status string, model binary, n_train long, n_val long, fit_seconds double, error string"


@dataclass(frozen=True)
class ExternalFit:
    """``scorer`` is None unless ``status`` is ``ok``; ``meta`` is a table of one row."""

    status: str
    scorer: FrameScorer | None
    meta: DataFrame


def _run(learner: Learner, columns: list[str], timeout_s: float):
    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[bool, Frames] = {True: [], False: []}
        for frame in frames:  # bounded: two samples
            for is_train, rows in frame.groupby("_train"):
                parts[bool(is_train)].append(rows[[*columns, "y"]].reset_index(drop=True))
        started = time.perf_counter()
        pool = ThreadPoolExecutor(max_workers=1)
        call = pool.submit(lambda: cloudpickle.dumps(learner(parts[True], parts[False])))
        done, _ = wait([call], timeout=timeout_s)
        pool.shutdown(wait=False, cancel_futures=True)
        model, error, status = None, None, "ok"
        if not done:
            status, error = "timeout", f"no model after {timeout_s} s"
        elif call.exception() is not None:
            status, error = "unavailable", f"{type(call.exception()).__name__}: {call.exception()}"
        else:
            model = call.result()
        yield pd.DataFrame({"status": [status], "model": [model],
                            "n_train": [sum(map(len, parts[True]))],
                            "n_val": [sum(map(len, parts[False]))],
                            "fit_seconds": [round(time.perf_counter() - started, 1)],
                            "error": [error]})
    return fit


def fit_external(train: DataFrame, val: DataFrame, test: DataFrame, learner: Learner,
                 columns: list[str] | None = None, rows: int = TRAIN_ROWS,
                 timeout_s: float = FIT_TIMEOUT_S,
                 score_timeout_s: float = SCORE_TIMEOUT_S) -> ExternalFit:
    """Fits on at most ``rows`` rows of train and as many of val; scores the whole test split.

    ``meta``: status, n_train, n_val, n_test, scored, fit_seconds, fitted_at, error, test_auc,
    test_ap. The job does not fail with the learner.
    """
    columns = columns or S.RAW_VIEW
    part = lambda d, is_train, salt: exact_sample(
        S.require_columns(d, [*columns, "y"]), rows, salt).select(
        *columns, "y", F.xxhash64("row_id", F.lit("external.order")).alias("_order"),
        F.lit(is_train).alias("_train"))
    given = part(train, True, "external.fit").unionByName(part(val, False, "external.val"))
    fitted = materialize(
        given.repartition(1).sortWithinPartitions(F.desc("_train"), "_order").drop("_order")
        .mapInPandas(_run(learner, columns, timeout_s), _FITTED, barrier=True), "external-fit")
    found = fitted.first()
    if found is None:  # no rows at all
        empty = train.sparkSession.range(1).select(F.lit("unavailable").alias("status"),
                                                   F.lit("no training rows").alias("error"))
        return ExternalFit("unavailable", None, empty)
    meta = fitted.drop("model").withColumn("fitted_at", F.current_timestamp())
    if found["status"] != "ok":
        none = F.lit(None).cast("double")
        return ExternalFit(found["status"], None, meta.withColumns({
            "n_test": F.lit(0).cast("long"), "scored": F.lit(0).cast("long"),
            "test_auc": none, "test_ap": none}))
    scorer = cloudpickle.loads(bytes(found["model"]))
    scores = materialize(external_scores(test, scorer, columns, score_timeout_s).join(
        test.select(F.col("row_id").alias("_id"), "y"), F.col("row_id") == F.col("_id")).select(
        "row_id", "y", F.lit("external").alias("head"), F.col("score").alias("p")), "external-test")
    counts = scores.agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("s"))
    metrics = ranking_metrics(scores.where(F.col("p").isNotNull()), ["head"])
    return ExternalFit("ok", scorer, meta.withColumns({
        "n_test": counts.select("n").scalar(), "scored": counts.select("s").scalar(),
        "test_auc": metrics.select("auc").scalar(), "test_ap": metrics.select("ap").scalar()}))
