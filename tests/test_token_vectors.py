"""Learned token vectors against numpy, and as the embedder of a training run."""

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from txnspark.operators import token_vectors as TV
from txnspark.operators import tokens as K
from txnspark.operators.metrics import ranking_metrics
from txnspark.plans import common as C
from txnspark.plans import training as T

FOLDER = "/root/testdata/sf0.001"


def encoded(spark):
    slots = K.with_slots(C.features(spark, FOLDER))
    return K.encode(slots, K.fit_vocabulary(slots), length=8)


def brute_weights(lists):
    n = Counter()
    for ids in lists:
        real = [i for i in ids if i >= len(K.SPECIALS)]
        for a, b in combinations(real, 2):
            n[a, b] += 1
            n[b, a] += 1
    single = Counter()
    for (a, _), k in n.items():
        single[a] += k
    total = sum(n.values())
    return {(a, b): w for (a, b), k in n.items()
            if (w := np.log(k * total / (single[a] * single[b]))) > 0}


def test_weights_and_vectors_equal_numpy(spark):
    rows = encoded(spark)
    found = TV.mutual_information(TV.cooccurrence(rows))
    want = brute_weights([r["ids"] for r in rows.select("ids").collect()])
    got = {(r["a"], r["b"]): r["weight"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    vectors = TV.learn_vectors(found, dim=8, steps=40).orderBy("id").collect()
    ids = sorted({a for a, _ in want})
    assert [r["id"] for r in vectors] == ids
    dense = np.zeros((len(ids), len(ids)))
    for (a, b), w in want.items():
        dense[ids.index(a), ids.index(b)] = w
    strength = np.linalg.svd(dense)[1]
    x = np.array([r["vector"] for r in vectors])
    # Columns are orthogonal and as long as the root of their singular value.
    gram = x.T @ x
    np.testing.assert_allclose(np.diag(gram)[:4], strength[:4], rtol=0.02)
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-6 * gram.max()


def test_embedder_reads_what_it_needs_and_minds_the_order(spark, path):
    vectors = spark.range(100).select("id", F.transform(F.array(*[F.lit(float(k)) for k in range(4)]),
                                                        lambda v: v + F.col("id")).alias("vector"))
    vectors.repartitionByRange(4, "id").write.parquet(path)
    e = TV.TokenVectors(path, token_dim=4, dim=18)
    ids = np.array([[2, 10, 11, 3, 0], [2, 11, 10, 3, 0], [2, 999, 3, 0, 0]])
    out = e(ids)
    assert out.shape == (3, 18) and set(e._known) == {0, 2, 3, 10, 11, 999}
    assert (out[0] != out[1]).any() and not out[:, 16:].any()
    np.testing.assert_array_equal(out[0, :8], [2, 3, 4, 5, 10, 11, 12, 13])
    assert not out[2, 4:8].any()  # a token without a vector
    assert e.__getstate__()["_known"] == {}


def test_learned_embedding_beats_raw_columns(spark, path):
    # Each merchant trades under codes of one of two kinds, dealt at random over the code
    # numbers; fraud follows the kind. Raw columns show the number only.
    rows = C.split_features(spark, "/root/testdata/sf0.01")
    kind = F.pmod(F.xxhash64("merchant_name"), F.lit(2))
    code = F.pmod(F.xxhash64("row_id"), F.lit(40)) * 2 + kind
    mixed = F.pmod(code * 37, F.lit(83))
    fraud = F.when(F.pmod(F.xxhash64("row_id", F.lit("label")), F.lit(10)) == 0, 1 - kind).otherwise(kind)
    rows = rows.withColumns({"mcc": (F.lit(4000) + mixed).cast("int"), "y": fraud.cast("int"),
                             "merchant_name": F.pmod(F.xxhash64("merchant_name", F.lit("n")), F.lit(10 ** 6))})
    t = T.train_heads(rows, None, 3, depth=2, components=16, embedder=T.LEARNED)
    auc = {r["head"]: r["auc"] for r in ranking_metrics(t.scores, ["head"]).collect()}
    assert auc["embed"] > auc["raw"] + 0.05, auc
    t.bundle.save(path)
    again = T.Bundle.load(spark, path)
    assert again.embedder.path == f"{path}/token_vectors"
    test = rows.where(F.col("split") == "test")
    a = {r["row_id"]: r["p_embed"] for r in t.bundle.score(test).collect()}
    b = {r["row_id"]: r["p_embed"] for r in again.score(test).collect()}
    assert a == b and len(a)
