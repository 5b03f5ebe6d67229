import re

from helpers import EDGES, documents, edges, empty, sample
from pyspark.sql import functions as F

from txnspark.llm.mixing import MOST, mix, mixed_documents


def brute_targets(sizes):
    """Shares the excess of capped sources again and again, as the rule says."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]] if free else []
        if not over:
            return {**capped, **{s: left * weight[s] / total for s in free}}
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]


def check(rows, given):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in given:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    assert len(rows) == len(given)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["copies"] <= MOST
    return sizes, want


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_targets_and_taken_words(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(given).collect()
    sizes, want = check(rows, as_rows(given))
    for s, target in want.items():
        taken = sum(r["size"] * r["copies"] for r in rows if r["source"] == s)
        assert abs(taken - target) < 0.03 * target


def test_the_mix_does_not_depend_on_the_layout(spark):
    given = sample(spark)
    first = sorted((r["doc_id"], r["copies"]) for r in mix(given).collect())
    again = sorted((r["doc_id"], r["copies"]) for r in mix(given.repartition(7)).collect())
    assert first == again
    taken = mixed_documents(given)
    assert taken.columns == given.columns
    counts = {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in first if n}


def test_a_hot_source_and_a_tiny_one(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    check(mix(documents(spark, rows)).collect(), rows)


def test_edges(spark):
    check(mix(edges(spark)).collect(), EDGES)
    taken = mixed_documents(edges(spark))
    assert taken.columns == edges(spark).columns
    assert taken.where(F.col("size") != "size").count() == 0
    assert mix(empty(spark)).collect() == [] and mixed_documents(empty(spark)).collect() == []
    silent = documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert {(r["target"], r["copies"]) for r in mix(silent).collect()} == {(0.0, 0)}
