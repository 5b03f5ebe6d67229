"""Streams with state per card, and the index of landed keys."""

import numpy as np
from pyspark.sql import functions as F

from txnspark.operators.ordered import time_gap
from txnspark.plans import common as C
from txnspark.session import new_path
from txnspark.streaming import jobs, key_index, keyed

FOLDER = "/root/testdata/sf0.001"


def test_place_equals_a_sort_whatever_the_order():
    draw = np.random.default_rng(5)
    for delay in (10, 1000):
        ts, ids = draw.integers(0, 200, 60), draw.permutation(60)
        state, newest, late = None, {}, set()
        for at in np.array_split(draw.permutation(60), 7):
            out, state = keyed.place(ts[at], ids[at], state, delay)
            for t, i, p, s in zip(out["ts"], out["ids"], out["prev"], out["status"]):
                newest[int(i)] = int(p)
                if s == keyed.LATE:
                    late.add(int(i))
        order = np.lexsort((ids, ts))
        if delay == 1000:  # everything stays in the window
            assert not late
            want = {int(ids[b]): int(ts[a]) for a, b in zip(order, order[1:])}
            assert {i: p for i, p in newest.items() if p != keyed._NO_TIME} == want
        else:
            assert late and set(newest) == set(range(60))


def test_state_keeps_the_window_only():
    out, state = keyed.place(np.arange(0, 1000, 10), np.arange(100), None, 50)
    assert len(state[2]) == 6 and state[0] == 930 and len(out["ids"]) == 100
    out, after = keyed.place(np.array([5]), np.array([900]), state, 50)
    assert out["status"].tolist() == [keyed.LATE] and after == state


def test_shuffled_batches_equal_the_batch_scan(spark):
    root = new_path(spark, "keyed")
    rows = C.features(spark, FOLDER).select("row_id", "user", "card", "ts")
    chunk = F.pmod(F.xxhash64("row_id"), F.lit(3))
    for k in range(3):
        rows.where(chunk == k).write.mode("append").parquet(f"{root}/in")
        stream = jobs.read_stream(spark, f"{root}/in", rows.schema)
        keyed.keyed_gap_stream(stream, f"{root}/out", f"{root}/cp", 3 * 86_400).awaitTermination()
        landed = spark.read.parquet(f"{root}/out").where(F.col("batch_id") == k)
        # A batch lands its own rows and at most one revised row for each of them.
        new = rows.where(chunk == k).count()
        assert new <= landed.count() <= 2 * new
    want = {r["row_id"]: r["time_delta_s"] for r in time_gap(rows).collect()}
    got = {r["row_id"]: r["time_delta_s"] for r in keyed.keyed_gaps(spark, f"{root}/out").collect()}
    assert got == want


def test_filters_never_miss():
    draw = np.random.default_rng(1)
    inside = draw.integers(-2 ** 63, 2 ** 63 - 1, 5000)
    other = draw.integers(-2 ** 63, 2 ** 63 - 1, 5000)
    bits = key_index.build_filter(inside)
    assert key_index.may_hold(bits, inside).all()
    assert key_index.may_hold(bits, other).mean() < 0.03
    assert not key_index.may_hold(key_index.build_filter(inside[:0]), other).any()


def test_index_keeps_each_key_once_and_stays_flat(spark):
    root = new_path(spark, "index")
    opened, alive, landed = [], [], set()
    for batch in range(18):
        keys = [*range(batch * 20, batch * 20 + 20)] + ([3, 25, None] if batch % 6 == 5 else [])
        rows = spark.createDataFrame([(k,) for k in keys], "row_id long")
        index = key_index.KeyIndex(spark, root, buckets=4)
        fresh = index.unseen(rows, "row_id", batch)
        got = {r["row_id"] for r in fresh.collect()}
        assert got == set(keys) - landed
        if batch == 5:  # a replay finds the same rows
            index.add(fresh, "row_id", batch)
            again = key_index.KeyIndex(spark, root, buckets=4).unseen(rows, "row_id", batch)
            assert {r["row_id"] for r in again.collect()} == got
        index.add(fresh, "row_id", batch)
        landed |= got
        opened.append(index.opened)
        alive.append(len(index._alive(batch)))
    assert max(alive) <= 2 * key_index.FAN
    quiet = [n for b, n in enumerate(opened) if b % 6 != 5]
    assert max(quiet) <= 3  # only what the filters let through by chance


def test_empty_batches_leave_the_index_as_it_is(spark):
    index = key_index.KeyIndex(spark, new_path(spark, "index"), buckets=2)
    one = spark.createDataFrame([(1,)], "row_id long")
    index.add(one, "row_id", 0)
    index.add(one.limit(0), "row_id", 1)
    assert index.unseen(one, "row_id", 2).collect() == []


def test_a_card_takes_and_gives_plain_rows():
    from types import SimpleNamespace

    from pyspark.sql import Row
    kept = []
    gaps = keyed.CardGaps(10_000_000, None)
    gaps.recent = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append)
    run = lambda *rows: [tuple(r) for r in gaps.handleInputRows(
        ("u", 3), iter([Row(micros=m, row_id=i) for m, i in rows]), None)]
    got = run((5_000_000, 2), (2_000_000, 1), (None, 9))
    assert got == [(9, "u", 3, keyed._NO_TIME, None, keyed.FIRST),
                   (1, "u", 3, 2_000_000, None, keyed.PLACED),
                   (2, "u", 3, 5_000_000, 3.0, keyed.PLACED)]
    assert run((6_500_000, 4)) == [(4, "u", 3, 6_500_000, 1.5, keyed.PLACED)]
