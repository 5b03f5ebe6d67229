"""Samples and splits on literal frames, and their independence from the layout."""

import pytest
from pyspark.sql import functions as F

from txnspark.functions.hashing import bucket, choice, normal, uniform
from txnspark.operators import sampling as P
from txnspark.operators.splits import split_plan, with_split


def rows(spark, n, every=10):
    return spark.range(n).select(F.col("id").alias("row_id"),
                                 (F.col("id") % every == 0).cast("int").alias("y"))


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
def test_exact_sample_size(spark, n):
    ids = [r["row_id"] for r in P.exact_sample(rows(spark, 1000), n, "s").collect()]
    assert len(ids) == len(set(ids)) == min(n, 1000)


def test_exact_sample_is_the_smallest_draws(spark):
    df = rows(spark, 3000).withColumn("u", uniform("row_id", "s"))
    want = {r["row_id"] for r in df.orderBy("u", "row_id").limit(123).collect()}
    for bins in (1, 7, 65536):
        assert {r["row_id"] for r in P.exact_sample(df, 123, "s", bins=bins).collect()} == want


@pytest.mark.parametrize("budget,ones,zeros", [
    (100, 10, 90), (5000, 200, 1800), (1, 0, 1), (10 ** 6, 200, 1800)])
def test_balanced_sample_sizes(spark, budget, ones, zeros):
    got = P.balanced_sample(rows(spark, 2000), budget, "b").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {k: v for k, v in ((1, ones), (0, zeros)) if v}


def test_balanced_sample_with_one_class(spark):
    only = rows(spark, 500).withColumn("y", F.lit(0))
    assert P.balanced_sample(only, 100, "b").count() == 100


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_layout_independence(spark, shuffle_partitions, partitions):
    base = {r["row_id"] for r in P.exact_sample(rows(spark, 2000), 77, "s").collect()}
    shuffle_partitions(partitions)
    other = P.exact_sample(rows(spark, 2000).repartition(partitions), 77, "s")
    assert {r["row_id"] for r in other.collect()} == base


def test_rate_of_one_keeps_all_and_positives_stay(spark):
    df = rows(spark, 400)
    assert P.bernoulli_sample(df, 1.0, "s").count() == 400
    assert P.keep_positives(df, 0.0, "s").count() == 40


def test_draws(spark):
    d = spark.range(20000).select(
        uniform("id", "a").alias("u"), normal("id", "a").alias("z"), bucket("id", 50).alias("b"),
        bucket("id", 50, "xxhash64").alias("x"),
        choice("id", "c", ["p", "q"], [0.7, 0.3]).alias("c"))
    s = d.agg(F.avg("u").alias("u"), F.avg("z").alias("m"), F.stddev("z").alias("s"),
              F.countDistinct("b").alias("b"), F.countDistinct("x").alias("x"),
              F.avg((F.col("c") == "p").cast("double")).alias("p"),
              F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(s["u"] - 0.5) < 0.02 and abs(s["m"]) < 0.03 and abs(s["s"] - 1) < 0.03
    assert s["b"] == s["x"] == 50 and abs(s["p"] - 0.7) < 0.02
    assert 0 <= s["lo"] and s["hi"] < 1


def dated(spark, counts):
    data = [(d,) for d, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "d int")


def test_cut_date_belongs_to_the_later_split(spark):
    df = dated(spark, {20240101: 5, 20240102: 3, 20240103: 1, 20240104: 1})
    plan = split_plan(df).first()
    assert (plan["train_cut"], plan["test_cut"]) == (20240102, 20240103)
    assert (plan["n_train"], plan["n_val"], plan["n_test"]) == (5, 3, 2)
    got = {r["d"]: r["split"] for r in with_split(df, split_plan(df)).distinct().collect()}
    assert got == {20240101: "train", 20240102: "val", 20240103: "test", 20240104: "test"}


def test_one_heavy_date_leaves_no_validation(spark):
    plan = split_plan(dated(spark, {20240101: 1, 20240102: 8, 20240103: 1})).first()
    assert plan["train_cut"] == plan["test_cut"] == 20240102 and plan["n_val"] == 0


def test_rates(spark):
    plan = split_plan(dated(spark, {20240101: 70, 20240102: 20, 20240103: 10}),
                      train_cap=35, eval_rows=100).first()
    assert plan["keep_train"] == 0.5 and plan["keep_test"] == 1.0


@pytest.mark.parametrize("n", [0, 1, 500, 999, 1000, 2000])
def test_first_rows(spark, n):
    df = rows(spark, 1000).repartition(6)
    got = sorted(r["row_id"] for r in P.first_rows(df, n, ranges=16).collect())
    assert got == list(range(min(n, 1000)))


def test_exact_quantiles(spark):
    import numpy as np

    from txnspark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(4)
    values = np.where(rng.random(999) < 0.34, 5.0, np.round(rng.normal(5, 3, 999), 1))
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)],
                               "g int, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, "v", probabilities, ["g"], ranges=12).collect()
    for g in (0, 1):
        want = np.quantile(values[g::2], probabilities)
        mine = [r["value"] for r in sorted(got, key=lambda r: r["i"]) if r["g"] == g]
        assert np.allclose(mine, want)
    whole = sorted((r["i"], r["value"]) for r in exact_quantiles(df, "v", probabilities).collect())
    assert np.allclose([v for _, v in whole], np.quantile(values, probabilities))
