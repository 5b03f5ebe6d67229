"""Targets, manifests, appends, histories and budgets."""

import pytest
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.plans import runs as R
from txnspark.session import new_path
from txnspark.sources import delimited, documents, targets


def split_rows(spark, n=90):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.element_at(F.array(*map(F.lit, S.SPLITS)), (F.col("id") % 3 + 1).cast("int"))
        .alias("split"))


@pytest.mark.parametrize("kind", ["path", "table"])
def test_target_round_trip(spark, path, kind):
    name = path if kind == "path" else "t_" + path[-32:]
    target = targets.DataTarget(kind, name, path if kind == "table" else None)
    assert not targets.is_ready(spark, target)
    assert targets.ingest_once(split_rows(spark), target)
    assert targets.is_ready(spark, target)
    assert not targets.ingest_once(split_rows(spark, 9), target)
    assert target.read_split(spark, "val", ["row_id"]).count() == 30
    assert targets.ingest_once(split_rows(spark, 9), target, force=True)
    assert target.read(spark).count() == 9


def test_table_without_a_location(spark, path):
    target = targets.DataTarget("table", "m_" + path[-32:])
    target.write_splits(split_rows(spark, 6))
    assert target.read(spark).count() == 6
    spark.sql(f"DROP TABLE {target.name}")


def test_readiness_of_a_missing_split(spark, path):
    target = targets.DataTarget("path", path)
    target.write_splits(split_rows(spark).where("split <> 'val'"))
    got = {r["split"]: (r["rows"], r["ready"]) for r in targets.readiness(spark, target).collect()}
    assert got == {"train": (30, True), "val": (None, False), "test": (30, True)}


def test_footer_counts(spark, path):
    spark.range(1234).select(F.concat(F.lit("$"), F.col("id").cast("string"), F.lit(".00"))
                             .alias("Amount")).write.parquet(path)
    counted = targets.footer_counts(spark, path)
    assert counted.first()["n"] == 1234
    plan = counted._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_footer_count_of_odd_places(spark, path):
    assert targets.safe_footer_count(spark, path + "-nothing") is None
    spark.createDataFrame([("not parquet at all",)], "v string").write.text(path)
    assert targets.safe_footer_count(spark, path) == 0


def test_manifest_prefers_the_newest_stamp(spark, path):
    target, manifest = targets.DataTarget("path", path), path + "-manifest"
    targets.write_with_manifest(split_rows(spark, 90), target, manifest)
    targets.write_with_manifest(split_rows(spark, 30), target, manifest)
    got = {r["split"]: r["rows"] for r in targets.manifest_counts(spark, manifest).collect()}
    assert got == {"train": 10, "val": 10, "test": 10}


def test_append_skips_landed_and_stops_on_partial(spark, path):
    df = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("batch_id"))
    targets.append_once(df.where("batch_id < 2"), path)
    targets.append_once(df, path)
    targets.append_once(df, path)
    assert spark.read.parquet(path).count() == 40
    with pytest.raises(ValueError, match="landed only in part"):
        targets.append_once(df.where("id <> 5"), path)


def test_csv_headers(spark, path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "A int, B string, C double")
    delimited.write_csv(df.toDF(" A", "B ", " C "), path)
    types = {f.name: f.dataType for f in df.schema}
    got = delimited.scan_csv(spark, path, {"C": types["C"], "A": types["A"]})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2.5, 1), (None, 2)], key=str)
    with pytest.raises(ValueError, match="missing"):
        delimited.scan_csv(spark, path, {"Z": types["A"]})


def test_contracts(spark):
    df = spark.createDataFrame([(1,)], "row_id long")
    with pytest.raises(ValueError, match="amount"):
        S.require_columns(df, ["row_id", "amount"])
    with pytest.raises(ValueError, match="empty"):
        S.require_rows(df.where("row_id > 5"), "rows")
    assert S.component_columns(["pca_10", "x", "pca_2", "pca_0"]) == ["pca_0", "pca_2", "pca_10"]
    assert len(S.source_columns()) == 14 and "hour" not in S.source_columns()


# ---- runs ------------------------------------------------------------------------------


def budgets(spark, ceiling=R.ROWS_CEILING, n=9):
    df = spark.range(1, n + 1).select(F.col("id").cast("int").alias("run"))
    rows = df.select("run", R.budget(F.col("run"), ceiling).alias("b")).orderBy("run").collect()
    return [(r["b"]["embed_max"], r["b"]["scale"]) for r in rows]


def test_budget_ladder(spark):
    b = budgets(spark)
    assert b[:5] == [(4000, 0.35), (8000, 0.55), (12000, 0.75), (16000, 0.9), (20000, 1.0)]
    assert b == sorted(b) and set(b[4:]) == {(20000, 1.0)}
    assert [rows for rows, _ in budgets(spark, 6000)][::4] == [4000, 6000, 6000]


def test_rounds_keep_a_floor_and_round_halves_to_even(spark):
    got = spark.range(1).select(R.scaled_rounds(400, F.lit(0.35)).alias("a"),
                                R.scaled_rounds(100, F.lit(0.35)).alias("b"),
                                R.scaled_rounds(125, F.lit(0.5)).alias("c")).first()
    assert tuple(got) == (140, 60, 62)


def record(spark, run):
    return spark.range(1).select(
        F.lit(run).alias("run"), F.lit(f"r{run}-x").alias("run_id"),
        R.empty_registry().alias("registry"))


def test_history_survives_missing_and_corrupt_files(spark, path):
    assert documents.run_history(spark, path).count() == 0
    documents.append_runs(record(spark, 1), path)
    spark.createDataFrame([("{not json",)], "v string").write.mode("append").text(path)
    documents.append_runs(record(spark, 2), path)
    h = documents.run_history(spark, path)
    assert [r["run"] for r in h.orderBy("run").collect()] == [1, 2]
    nxt = h.select(R.append_index(h).alias("n")).distinct().first()["n"]
    assert nxt == 3


def test_registry_patch(spark, path):
    documents.append_runs(record(spark, 1).unionByName(record(spark, 2)), path)
    h = documents.run_history(spark, path)
    patch = spark.createDataFrame([("r2-x", True, 3), ("r99-nope", True, 9)],
                                  "run_id string, registered boolean, model_version int")
    got = {r["run"]: r["registry"] for r in R.patch_registry(h, patch).collect()}
    assert set(got) == {1, 2}
    assert (got[2]["registered"], got[2]["model_version"], got[2]["deployed"]) == (True, 3, False)
    assert got[1]["registered"] is False and got[1]["model_version"] is None


def curve(spark, values):
    return spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(values)],
                                 "model string, round int, auc double")


def test_early_stop_and_best_round(spark):
    values = [0.5, 0.6, 0.6, 0.59, 0.58, 0.61, 0.60, 0.60, 0.60, 0.7]
    got = R.early_stop(curve(spark, values), ["model"], patience=3).first()
    assert (got["stop_round"], got["best_round"]) == (5, 2)
    got = R.early_stop(curve(spark, values), ["model"], patience=20).first()
    assert (got["stop_round"], got["best_round"]) == (10, 10)
    assert R.best_round(curve(spark, [0.5, 0.7, 0.7]), ["model"]).first()["best_round"] == 2


def test_paths_are_fresh(spark):
    assert new_path(spark, "a") != new_path(spark, "a")
