"""User-supplied models: scorers, scoring functions and batch transports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators.sampling import exact_sample

# --- fixed values: limits of the external scorer contract ---
SCORE_TIMEOUT_S = 2.5
TRAIN_ROWS = 20_000
# --- end of fixed values ---

FrameScorer = Callable[[pd.DataFrame], np.ndarray]


class _TimedCalls:
    """Runs a scorer with a deadline per batch, on a thread of this task's own.

    A call past its deadline is abandoned with its thread; the next batch gets a new one.
    """

    def __init__(self, scorer: FrameScorer, timeout_s: float):
        self.scorer, self.timeout_s, self.pool = scorer, timeout_s, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)

    def __call__(self, frame: pd.DataFrame) -> tuple[np.ndarray | None, str]:
        self.pool = self.pool or ThreadPoolExecutor(max_workers=1)
        call = self.pool.submit(self.scorer, frame)
        done, _ = wait([call], timeout=self.timeout_s)
        if not done:
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = None
            return None, "timeout"
        if call.exception() is not None:
            return None, "unavailable"
        return call.result(), "ok"


def _probabilities(values, rows: int) -> np.ndarray | None:
    """One number per row; what is no probability becomes NaN. None for another length."""
    try:
        numbers = np.asarray(values, dtype=float)
    except (TypeError, ValueError):
        return None
    if numbers.shape != (rows,):
        return None
    return np.where((numbers >= 0) & (numbers <= 1), numbers, np.nan)


def external_scores(df: DataFrame, scorer: FrameScorer, columns: list[str] | None = None,
                    timeout_s: float = SCORE_TIMEOUT_S, key: str = "row_id") -> DataFrame:
    """(key, score, status, latency_ms) from a scorer of untransformed raw rows.

    A batch that fails, is late or has another length gets NULL scores and a status, and a
    single value that is no probability a NULL and ``unavailable``; the job never fails.
    """
    columns = columns or S.RAW_VIEW

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _TimedCalls(scorer, timeout_s) as score:
            for frame in frames:
                started = time.perf_counter()
                values, status = score(frame[columns])
                took = round((time.perf_counter() - started) * 1000, 1)
                out = pd.DataFrame({key: frame[key], "score": np.nan, "status": status,
                                    "latency_ms": took if status == "ok" else None})
                if status == "ok":
                    numbers = _probabilities(values, len(frame))
                    out["score"] = np.nan if numbers is None else numbers
                    out.loc[out["score"].isna(), ["status", "latency_ms"]] = [
                        "unavailable", None]
                out["score"] = out["score"].astype(object).where(out["score"].notna(), None)
                yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(
        run, f"{key} {kind}, score double, status string, latency_ms double")


def external_training_rows(train: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """What an external fit may see: a repeatable random sample of ``rows`` training rows."""
    return exact_sample(S.require_columns(train, S.RAW_VIEW), rows, "external.fit")


class FrameModel:
    """Base of a pluggable model: ``load_context`` once per task, then ``predict``."""

    def load_context(self, context: dict) -> None:
        pass

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError


def apply_model(df: DataFrame, model: FrameModel, context: dict, columns: list[str],
                key: str = "row_id") -> DataFrame:
    """(key, prediction); the model is loaded once per task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load_context(context)
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "prediction": np.asarray(
                model.predict(frame[columns]), dtype=float)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, prediction double")


def scoring_function(predict: Callable[[dict], dict], columns: list[str]) -> Column:
    """``predict({"rows": [...]}) -> {"probability": [...]}`` as a column."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            reply = predict({"rows": frame.to_dict("records")})
            yield pd.Series(reply["probability"], dtype=float)

    return run(F.struct(*columns))
