import math
import zlib

import pytest
from helpers import EDGES, edges, empty, sample
from pyspark.sql import functions as F

from txnspark.llm.sharding import _hypergeometric, communication_matrix, uniform_shards


def check(rows, given):
    n = len(given)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(map(len, by.values())) == sorted(
        s for s in (n // 8 + (k < n % 8) for k in range(8)) if s)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    data = [(i, (t or "").encode()) for i, t, *_ in given]
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], key=repr) == sorted(
        [(i, len(b) + 1, zlib.crc32(b)) for i, b in data], key=repr)


@pytest.mark.parametrize("block_rows", [40, 20_000])
def test_exact_sizes_and_gapless_slots(spark, block_rows):
    given = sample(spark)
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    placed = uniform_shards(given, block_rows=block_rows)
    check(placed.collect(), rows)
    again = uniform_shards(given.repartition(5), block_rows=block_rows)
    assert sorted(placed.collect()) == sorted(again.collect())


def test_edges(spark):
    check(uniform_shards(edges(spark)).collect(), EDGES)
    assert uniform_shards(empty(spark)).collect() == []


def test_matrix_has_exact_sums(spark):
    sizes = [0, 5, 300, 41, 0, 0, 7, 1000, 2, 2, 3]
    table = spark.createDataFrame([(b, n) for b, n in enumerate(sizes) if n], "block long, n long")
    rows = {r["block"]: r["counts"] for r in communication_matrix(table, 8, 3).collect()}
    for b, n in enumerate(sizes):
        assert sum(rows[b]) == n and min(rows[b]) >= 0
    total = sum(sizes)
    assert [sum(c[s] for c in rows.values()) for s in range(8)] == [
        total // 8 + (s < total % 8) for s in range(8)]


@pytest.mark.parametrize("n,k,d", [(20, 8, 7), (60, 30, 30), (9, 9, 4), (5, 0, 3), (0, 0, 0)])
def test_draws_follow_the_hypergeometric_law(spark, n, k, d):
    draws = 4000
    c = [F.lit(v).cast("long") for v in (n, k, d)]
    u = (F.col("id") + 0.5) / draws  # an even grid of u makes the counts near exact
    got = {r["x"]: r["count"] for r in spark.range(draws).select(
        _hypergeometric(*c, u).alias("x")).groupBy("x").count().collect()}
    for x in range(d + 1):
        p = (math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d)
             if x <= k and d - x <= n - k else 0.0)
        assert abs(got.get(x, 0) - p * draws) <= 1.5


def test_rows_are_spread_evenly(spark):
    rows = spark.range(1600).select(
        F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    hits = [[0] * 8 for _ in range(16)]
    for seed in range(4):
        for r in uniform_shards(rows, seed=seed * 10, block_rows=100).collect():
            hits[r["doc_id"] // 100][r["shard"]] += 1
    chi = sum((x - 50) ** 2 / 50 for row in hits for x in row)
    assert 60 < chi < 160  # about 105 degrees of freedom
