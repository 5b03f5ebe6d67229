"""Toxicity scores against a plain Kneser-Ney model, and on held-out labels."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import EDGES, documents, edges, empty, sample
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from txnspark.llm import toxicity
from txnspark.session import materialize

SF = "/root/testdata/sf0.01"


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def spelt(word):
    s = b" " + word + b" "
    return [s[max(0, e - 6):e + 1] for e in range(1, len(s))]


def brute_ratios(texts):
    """texts: (text, toxic). Function from a word to its log likelihood ratio."""
    counts = (Counter(), Counter())
    for text, y in texts:
        for w in text.lower().encode().split():
            counts[y].update(spelt(w))
    both = counts[0] + counts[1]
    types = {g[-k:] for g in both for k in range(1, len(g) + 1)}
    before = Counter(g[1:] for g in types if len(g) > 1)
    starts = lambda g: len(g) > 1 and g[0] == 32
    n = {g: both[g] if len(g) == 7 or starts(g) else before[g] for g in types}
    total, follow = Counter(), Counter()
    for g, k in n.items():
        total[g[:-1]] += k
        follow[g[:-1]] += 1

    def pooled(g):
        p = 1 / 256
        for k in range(1, len(g) + 1):
            h = g[-k:]
            p = (max(n[h] - 0.75, 0) + 0.75 * follow[h[:-1]] * p) / total[h[:-1]]
        return p
    sums = [defaultdict(lambda: [0, 0.0]) for _ in (0, 1)]
    for y in (0, 1):
        for g, k in counts[y].items():
            sums[y][g[:-1]][0] += k
            sums[y][g[:-1]][1] += min(k, 4.0)

    def chance(y, g):
        t, free = sums[y].get(g[:-1], (0, 0.0))
        if g not in n:   # unseen: the pooled model is shared, what is left for it differs
            return free / t if t else 1.0
        p = pooled(g)
        return (max(counts[y][g] - 4.0, 0) + free * p) / t if t else p
    return lambda w: sum(math.log(chance(1, g) / chance(0, g)) for g in spelt(w))


def fitted(rows):
    """The rows (doc_id, text, toxic) that are counted."""
    return [(t or "", y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]


@pytest.fixture(scope="module")
def small(spark):
    rows = [tuple(r) for r in sample(spark, 250).join(labels(spark), "doc_id").select(
        "doc_id", "text", "toxic").collect()]
    return rows


def test_ratios_equal_a_plain_model(spark, small):
    marks = toxicity._marks(labels(spark))
    held = {r[0] for r in marks.where("calibrates").select("_doc").collect()}
    ratio = brute_ratios(fitted([r for r in small if r[0] not in held]))
    table = toxicity.ratios(materialize(
        toxicity.class_counts(sample(spark, 250), marks), "t"))
    found = table.toPandas().sort_values("gram")
    words = toxicity._Words(found["gram"].to_numpy(), found["ratio"].to_numpy())
    some = sorted({w for _, t, _ in small[:60] for w in t.lower().encode().split()}) + [
        b"idiot", b"never-seen-before", b"x" * 300, "schön".encode()]
    want = [max(0.0, ratio(w) - toxicity.MARGIN) for w in some]
    assert max(want) > 1
    np.testing.assert_allclose(words.evidence(some), want, atol=1e-9)


def test_joined_scores_equal_local_ones(spark):
    given = sample(spark, 300)
    a = {r[0]: r for r in toxicity.toxicity_scores(given, labels(spark)).collect()}
    b = {r[0]: r for r in toxicity.toxicity_scores(
        given.repartition(5), labels(spark), local_grams=0).collect()}
    assert set(a) == set(b)
    assert all(abs(a[i]["score"] - b[i]["score"]) < 1e-9 for i in a)


def test_held_out_documents(spark):
    rows = toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"),
                                    labels(spark)).join(labels(spark), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"]]).all()
    bad, good = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    auc = np.mean([(good < s).mean() + (good == s).mean() / 2 for s in bad])
    assert auc > 0.95
    clean = held[held["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.97
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_only_text_and_learnable_labels_count(spark):
    given, marks = sample(spark, 300), labels(spark)
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(col("doc_id")), 1 - col("toxic"))
                              .otherwise(col("toxic"))).withColumn("quality", F.lit(0))
    other = given.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    a = {r[0]: r["score"] for r in toxicity.toxicity_scores(given, marks).collect()}
    b = {r[0]: r["score"] for r in toxicity.toxicity_scores(other.repartition(6), turned).collect()}
    assert a == b


def test_edges(spark):
    rows = toxicity.toxicity_scores(edges(spark), labels(spark)).collect()
    assert len(rows) == len(EDGES) and all(0 < r["score"] < 1 for r in rows)
    silent = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert silent == {min(r["score"] for r in rows)}
    assert toxicity.toxicity_scores(empty(spark), labels(spark)).collect() == []
    none = toxicity.toxicity_scores(edges(spark), labels(spark).limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and not any(r["predicted"] for r in none)
    assert len(toxicity.toxicity_scores(edges(spark), labels(spark), local_grams=0).collect()) == len(EDGES)


def test_late_words_count(spark):
    text = "plain words here " * 4000
    docs = sample(spark, 1000).select("doc_id", "text", "lang", "source").union(
        documents(spark, [(90_001, text, "en", "s"), (90_002, text + "idiot moron scum " * 600, "en", "s")])
        .select("doc_id", "text", "lang", "source"))
    got = {r[0]: r["score"] for r in toxicity.toxicity_scores(docs, labels(spark)).collect()}
    assert got[90_002] > got[90_001]
