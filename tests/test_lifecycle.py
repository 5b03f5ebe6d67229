"""Two budgeted runs end to end."""

import numpy as np
from pyspark.sql import functions as F

from txnspark.plans import common as C
from txnspark.plans import lifecycle as L
from txnspark.plans import runs as R
from txnspark.plans import training as T
from txnspark.sources import documents


def test_two_runs(spark, path):
    def flat_scorer(frame):
        return np.where(frame["hour"] < 5, 0.8, 0.2)

    rows = C.features(spark, "/root/testdata/sf0.001").where("row_id < 900").withColumn(
        "split", F.when(F.col("row_id") < 600, "train").when(F.col("row_id") < 750, "val")
        .otherwise("test"))
    options = dict(rounds=3, depth=2, components=4, dim=16, patience=2)
    assert L.next_run(spark, path) == 1
    L.training_run(rows, path, **options)
    t = L.training_run(rows, path, bundle_path=f"{path}-bundle", scorer=flat_scorer,
                       scorer_columns=["hour"], **options)
    history = documents.run_history(spark, path).orderBy("run")
    first, second = history.collect()
    assert (first["run"], second["run"]) == (1, 2)
    assert (first["budget"]["embed_max"], second["budget"]["embed_max"]) == (4000, 8000)
    assert [m["key"] for m in second["models"]] == ["combined", "embed", "external", "raw"]
    assert (first["external"], second["external"]) == (False, True)
    assert second["registry"]["registered"] is False and second["duration_sec"] > 0
    d = second["diagnostics"]
    assert sum(b["legit"] + b["fraud"] for b in d["separation"]) == 150
    assert len(d["importance"]) == 15 and set(d["curves"]) == {"raw", "embed", "combined"}
    assert d["curves"]["raw"]["rounds"] == [1, 2, 3]
    assert 1 <= d["curves"]["raw"]["best_round"] <= 3
    pivot = R.metric_pivot(history, "test_auc").orderBy("run").collect()
    assert pivot[0]["external"] is None and pivot[1]["external"] is not None
    again = T.Bundle.load(spark, f"{path}-bundle")
    new = again.score(rows.where("split = 'test'")).select("row_id", "p_combined")
    old = t.scores.where("head = 'combined'")
    assert new.join(old, "row_id").where("abs(p - p_combined) > 1e-9").count() == 0


def test_own_embedder_and_extra_slots_are_trained_and_saved(spark, path):
    from txnspark.operators.ordered import time_gap
    from txnspark.operators.tokens import EXTRA_SLOTS

    def shape_embedder(ids):  # number, sum and largest of the ids
        return np.stack([(ids > 0).sum(axis=1), ids.sum(axis=1), ids.max(axis=1)], axis=1) / 100.0

    rows = time_gap(C.features(spark, "/root/testdata/sf0.001")).where("row_id < 600").withColumn(
        "split", F.when(F.col("row_id") < 400, "train").when(F.col("row_id") < 500, "val")
        .otherwise("test"))
    t = T.train_heads(rows, None, 2, depth=2, components=2, embedder=shape_embedder,
                      extra_slots=True)
    known = {r["token"].split("_")[0] for r in t.bundle.vocabulary.collect()}
    assert {"DOW", "DT", "MCCG"} <= known and len(EXTRA_SLOTS) == 3
    t.bundle.save(path)
    test = rows.where("split = 'test'")
    new = T.Bundle.load(spark, path).score(test, "ids").select(
        F.col("row_id").alias("_id"), F.col("p_combined").alias("q"), "ids")
    both = t.bundle.score(test).join(new, F.col("row_id") == F.col("_id"))
    assert both.count() == 100 and both.where("abs(p_combined - q) > 1e-9").count() == 0
    assert {len([i for i in r["ids"] if i]) for r in new.collect()} == {11}
