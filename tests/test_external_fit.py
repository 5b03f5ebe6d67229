"""Fits of a user's learner on raw rows: metrics, failure, deadline, and its head in a run."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from txnspark.operators.external_fit import fit_external
from txnspark.operators.metrics import ranking_metrics
from txnspark.plans import common as C
from txnspark.plans import lifecycle as L
from txnspark.sources import documents

COLUMNS = ["use_chip", "hour", "amount_num"]


def split(spark, name):
    rows = C.split_features(spark, "/root/testdata/sf0.001")
    return rows.where(F.col("split") == name)


def learners():
    """Made inside a function, so workers get them by value."""
    def hour_rates(train, val):
        """Fraud rate per hour of the train rows."""
        rows = pd.concat(train)
        rates, usual = rows.groupby("hour")["y"].mean(), rows["y"].mean()
        return lambda frame: frame["hour"].map(rates).fillna(usual).to_numpy()

    def broken(train, val):
        raise ConnectionError("no service")

    def slow(train, val):
        time.sleep(30)

    return hour_rates, broken, slow


hour_rates, broken, slow = learners()


def test_fit_and_metrics(spark):
    train, val, test = (split(spark, s) for s in ("train", "val", "test"))
    fit = fit_external(train, val, test, hour_rates, COLUMNS, score_timeout_s=60)
    meta = fit.meta.first()
    assert fit.status == "ok" and meta["n_train"] == train.count() and meta["n_val"] == val.count()
    assert meta["n_test"] == meta["scored"] == test.count()
    rows = train.select("hour", "y").toPandas()
    rates, usual = rows.groupby("hour")["y"].mean(), rows["y"].mean()
    want = test.select("row_id", "hour", "y").toPandas()
    want["p"] = want["hour"].map(rates).fillna(usual)
    m = ranking_metrics(spark.createDataFrame(want[["row_id", "y", "p"]]).withColumn(
        "head", F.lit("external")), ["head"]).first()
    assert abs(meta["test_auc"] - m["auc"]) < 1e-12 and abs(meta["test_ap"] - m["ap"]) < 1e-12


def test_sample_is_bounded_and_repeatable(spark):
    train, val, test = (split(spark, s) for s in ("train", "val", "test"))

    def seen(parts, _):
        total = float(pd.concat(parts)["amount_num"].sum())
        return lambda frame: np.full(len(frame), total % 1)
    a, b = (fit_external(train.repartition(n), val, test, seen, COLUMNS, rows=100,
                         score_timeout_s=60) for n in (2, 7))
    assert a.meta.first()["n_train"] == 100
    frame = pd.DataFrame({"hour": [1]})
    assert a.scorer(frame) == b.scorer(frame)


def test_failure_and_deadline_are_a_status(spark):
    train, val, test = (split(spark, s) for s in ("train", "val", "test"))
    for learner, status in ((broken, "unavailable"), (slow, "timeout")):
        fit = fit_external(train, val, test, learner, COLUMNS, timeout_s=2)
        meta = fit.meta.first()
        assert (fit.status, fit.scorer, meta["test_auc"]) == (status, None, None)
        assert meta["status"] == status and meta["error"]


def test_fitted_head_joins_a_run(spark, path):
    rows = C.split_features(spark, "/root/testdata/sf0.001")
    L.training_run(rows, path, learner=hour_rates, scorer_columns=COLUMNS, rounds=2, depth=2,
                   components=4, dim=16, patience=2)
    record = documents.run_history(spark, path).first()
    assert record["external"] is True
    assert "external" in [m["key"] for m in record["models"]]
    L.training_run(rows, path, learner=broken, scorer_columns=COLUMNS, rounds=2, depth=2,
                   components=4, dim=16, patience=2)
    assert documents.run_history(spark, path).where("run = 2").first()["external"] is False
