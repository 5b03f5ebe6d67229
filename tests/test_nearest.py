"""Nearest rows by cosine against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnspark.operators import nearest as N

SF = "/root/testdata/sf0.01"


def brute(rows, k):
    """rows: (id, vector) -> {id: [(neighbour, cosine)]}."""
    ids, x = np.array([r[0] for r in rows]), N.unit(np.array([r[1] for r in rows], dtype=float))
    scores = x @ x.T
    out = {}
    for a in range(len(ids)):
        order = [b for b in np.lexsort((ids, -np.round(scores[a], 12))) if b != a][:k]
        out[int(ids[a])] = [(int(ids[b]), scores[a, b]) for b in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    return out


def recall(got, want):
    hits = [len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / len(want[i]) for i in want]
    return float(np.mean(hits))


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = collected(N.nearest_rows(df))
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.95
    # Cosines of what was found are exact.
    true = {(i, n): c for i in want for n, c in want[i]}
    assert all(abs(c - true[i, n]) < 1e-9 for i in got for n, c in got[i] if (i, n) in true)


@pytest.mark.parametrize("block", [16, 2048])
def test_all_lists_give_the_exact_answer(spark, block):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 150")
    got = collected(N.nearest_rows(df, k=5, probes=10_000, block=block))
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 5)
    assert {i: [n for n, _ in v] for i, v in got.items()} == {
        i: [n for n, _ in v] for i, v in want.items()}


def test_hot_copies_and_unusable_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 40").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    one = df.where("vec_id = 3").select(F.explode(F.sequence(
        F.lit(1000).cast("long"), F.lit(1059).cast("long"))).alias("vec_id"), "embedding")
    bad = spark.createDataFrame([(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64),
                                 (904, [1.0] * 5)], "vec_id long, embedding array<double>")
    got = collected(N.nearest_rows(df.union(one).union(bad), k=4, probes=10_000))
    assert set(got) == set(range(40)) | set(range(1000, 1060))
    assert [n for n, _ in got[3]] == [1000, 1001, 1002, 1003]
    assert [n for n, _ in got[1059]] == [3, 1000, 1001, 1002]
    assert all(len(v) == 4 and i not in {n for n, _ in v} for i, v in got.items())


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest_rows(df).collect() == []


def test_vectors_without_clusters_are_sent_once_a_block(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(16).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent, given = [], N.matches_of_blocks

    def counted(queries, members, pairs, k):
        sent.append(queries.join(pairs, "q").count() + members.join(pairs, "m").count())
        return given(queries, members, pairs, k)
    monkeypatch.setattr(N, "matches_of_blocks", counted)
    got = collected(N.nearest_rows(df, k=10, block=1000))
    assert sent[-1] <= 2 * 3000 * 9  # a few blocks, where most of 54 lists are read
    assert recall(got, brute(rows, 10)) >= 0.95


def test_truth_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "MIN_BLOCK", 40)
    monkeypatch.setattr(N, "BLOCKS", 3)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("entry"), F.col("embedding").alias("v"))
    asked = df.where("entry % 3 = 0")
    got = {}
    for r in N.exact_nearest(df, asked, 6).where("query <> entry").orderBy(
            "query", F.desc("cosine"), "entry").collect():
        got.setdefault(r["query"], []).append(r["entry"])
    want = brute([(r["entry"], r["v"]) for r in df.collect()], 5)
    assert got == {i: [n for n, _ in want[i]] for i in got} and len(got) == asked.count()
