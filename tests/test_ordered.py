"""Ordered scans against brute force: hot groups, ties, odd partition counts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnspark.operators import ordered as O


def hot_rows(n=4000, seed=1):
    """One user holds a third of all rows; times repeat."""
    rnd = random.Random(seed)
    return [(i, 7 if i % 3 == 0 else rnd.randrange(40), rnd.randrange(2), rnd.randrange(900))
            for i in range(n)]


def brute_previous(rows):
    last, out = {}, {}
    for rid, user, card, ts in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        out[rid] = last.get((user, card))
        last[(user, card)] = ts
    return out


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_previous_value_with_a_hot_group(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "row_id long, user long, card long, t long").repartition(5)
    got = {r["row_id"]: r["prev"] for r in O.previous_value(
        df, ["user", "card"], ["t", "row_id"], F.col("t"), "prev").collect()}
    assert got == brute_previous(rows)


def test_previous_value_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 1, 10, None), (2, 1, 20, 5), (3, 1, 30, 6)],
                               "row_id long, g long, t long, v long")
    got = {r["row_id"]: r["prev"] for r in O.previous_value(
        df, ["g"], ["t"], F.col("v"), "prev").collect()}
    assert got == {1: None, 2: None, 3: 5}


@pytest.mark.parametrize("ranges", [1, 3, 16, 200])
def test_prefix_sum_and_ids(spark, ranges):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(-5, 9)) for k in rnd.sample(range(10 ** 6), 3000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    total, want, pos = 0, {}, {}
    for i, (k, v) in enumerate(sorted(rows)):
        total += v
        want[k], pos[k] = total, i
    assert {r["k"]: r["s"] for r in O.prefix_sum(df, ["k"], {"s": "v"}, ranges=ranges).collect()
            } == want
    assert {r["k"]: r["pos"] for r in O.dense_ids(df, ["k"], ranges=ranges).collect()} == pos


def test_prefix_sum_per_group(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 3 else "b", i * 7 % 5003, rnd.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    want, totals = {}, {}
    for g, k, v in sorted(rows):
        totals[g] = totals.get(g, 0) + v
        want[(g, k)] = totals[g]
    got = O.prefix_sum(df, ["k"], {"s": "v"}, ["g"], ranges=24)
    assert {(r["g"], r["k"]): r["s"] for r in got.collect()} == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert O.prefix_sum(df, ["k"], {"s": "v"}).count() == 0
    assert O.previous_value(df, ["k"], ["v"], F.col("v"), "p").count() == 0


def test_ranges_are_balanced_for_a_hot_group(spark):
    df = spark.createDataFrame(hot_rows(20000), "row_id long, user long, card long, t long")
    order = ["user", "card", "t", "row_id"]
    sizes = [r["count"] for r in O.ranged(df, order, 32).groupBy("_range").count().collect()]
    assert len(sizes) >= 24 and max(sizes) < 3 * 20000 / 32


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "b" if i % 3 == 1 else "c", i)
                                for i in range(999)], "g string, k long")
    got = O.dense_ids(df, ["k"], group_by=["g"], ranges=16).collect()
    for g in (None, "b", "c"):
        assert sorted(r["pos"] for r in got if r["g"] == g) == list(range(333))
    middle = {(r["g"], r["k"]) for r in O.middle_rows(df, ["k"], "g").collect()}
    assert middle == {(None, 498), ("b", 499), ("c", 500)}
    before = O.previous_value(df, ["g"], ["k"], F.col("k"), "p", ranges=16).collect()
    assert all(r["p"] == (r["k"] - 3 if r["k"] > 2 else None) for r in before)


@pytest.mark.parametrize("length", [1, 2, 57, 100, 101, 150, 199, 200, 333, 1000, 1234, 7919])
def test_thinning_positions(spark, length):
    want = np.unique(np.linspace(0, length - 1, min(100, length)).astype(int))
    df = spark.range(length).withColumnRenamed("id", "pos")
    got = O.thin_positions(df, "pos", F.lit(length)).orderBy("pos")
    assert [r["pos"] for r in got.collect()] == want.tolist()


@pytest.mark.parametrize("positives,negatives,budget", [(3, 100, 23), (30, 50, 20), (2, 5, 50)])
def test_class_stride(spark, positives, negatives, budget):
    rows = [(i, 1 if i < positives else 0) for i in range(positives + negatives)]
    df = spark.createDataFrame(rows, "row_id long, y int")
    got = O.class_stride(df, ["row_id"], "y", budget).collect()
    room = max(0, budget - positives)
    stride = 1 if negatives <= room else (math.ceil(negatives / room) if room else negatives + 1)
    want = set(range(positives)) | {positives + i for i in range(0, negatives, stride)}
    assert {r["row_id"] for r in got} == want


def test_middle_rows_and_row_order_split(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(23)], "row_id long, y int")
    pools = {y: [i for i in range(23) if int(i % 5 == 0) == y] for y in (0, 1)}
    assert {(r["row_id"], r["y"]) for r in O.middle_rows(df, ["row_id"], "y").collect()} == {
        (pool[len(pool) // 2], y) for y, pool in pools.items()}
    split = {r["row_id"]: r["split"] for r in O.row_order_split(df, ["row_id"]).collect()}
    assert [split[i] for i in (15, 16, 18, 19)] == ["train", "val", "val", "test"]


def test_gap_of_equal_times_is_zero(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 1L, 1L, TIMESTAMP_NTZ'2024-01-01 00:00:00'),
      (2L, 1L, 1L, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (3L, 1L, 1L, TIMESTAMP_NTZ'2024-01-01 00:01:30')
      AS t(row_id, user, card, ts)""")
    got = {r["row_id"]: r["time_delta_s"] for r in O.time_gap(df).collect()}
    assert got == {1: None, 2: 0.0, 3: 90.0}


@pytest.mark.parametrize("cells,edge_rows", [(65536, 1_000_000), (4, 1), (1, 10)])
def test_rows_at_and_middle_rows(spark, cells, edge_rows):
    data = [(None if i % 97 == 0 else (i * 7919) % 100003, None if i % 11 == 0 else i % 3)
            for i in range(2000)]
    df = spark.createDataFrame(data, "k long, y int").dropDuplicates()
    groups = {}
    for r in df.collect():
        groups.setdefault(r["y"], []).append(r["k"])
    for keys in groups.values():
        keys.sort(key=lambda k: (k is not None, k or 0))
    got = {(r["y"], r["k"]) for r in O.middle_rows(df, ["k"], "y").collect()}
    assert got == {(y, keys[len(keys) // 2]) for y, keys in groups.items()}
    placed = df.where("k IS NOT NULL").select(
        F.col("y").alias("_s"), (F.col("k") / 100003.0).alias("_u"), F.col("k").alias("_k"))
    found = O.rows_at(placed, lambda sizes: {s: n // 3 for s, n in sizes.items()},
                      cells, edge_rows)
    for r in found:
        keys = [k for k in groups[r["_s"]] if k is not None]
        assert r["_k"] == keys[len(keys) // 3 - 1]
    assert len(found) == len(groups)


def test_rows_at_of_nothing(spark):
    empty = spark.createDataFrame([], "_s int, _u double, _k long")
    assert O.rows_at(empty, lambda sizes: sizes) == []
    assert O.middle_rows(spark.createDataFrame([], "k long, y int"), ["k"], "y").count() == 0
