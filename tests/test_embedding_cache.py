"""The cache of embeddings: reuse, other vocabularies and embedders, changed rows, re-ingest."""

import numpy as np
from pyspark.sql import functions as F

from txnspark.operators import vectors as V
from txnspark.operators.embedding_cache import EmbeddingCache, vocabulary_digest
from txnspark.sources import targets

VOCABULARY = [("a", 4), ("b", 5), ("c", 6)]


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, ids array<int>")


def got(df):
    return {r["row_id"]: tuple(r["embedding"]) for r in df.collect()}


def test_only_what_is_missing_is_computed(spark, path):
    vocabulary = spark.createDataFrame(VOCABULARY, "token string, id int")
    e = V.HashedProjection(10, 4)
    cache = EmbeddingCache(spark, path, "cards", "100")
    rows = [(k, [2, 4 + k % 3, 3]) for k in range(9)]
    first, n = cache.embed(table(spark, rows[:4]), vocabulary, e)
    every, m = cache.embed(table(spark, rows), vocabulary, e)
    assert (n, m) == (4, 5)
    assert got(every) == got(V.embed(table(spark, rows), e)) and len(got(first)) == 4
    assert cache.embed(table(spark, rows), vocabulary.repartition(3).orderBy("id"), e)[1] == 0


def test_changes_never_return_an_old_vector(spark, path):
    vocabulary = spark.createDataFrame(VOCABULARY, "token string, id int")
    swapped = spark.createDataFrame([("a", 5), ("b", 4), ("c", 6)], "token string, id int")
    assert vocabulary_digest(vocabulary) != vocabulary_digest(swapped)
    rows, e = [(1, [2, 4, 3]), (2, [2, 5, 3])], V.HashedProjection(10, 4)
    cache = EmbeddingCache(spark, path, "cards")
    cache.embed(table(spark, rows), vocabulary, e)
    assert cache.embed(table(spark, rows), swapped, e)[1] == 2
    assert cache.embed(table(spark, rows), vocabulary, V.HashedProjection(10, 4, seed=7))[1] == 2
    changed = [(1, [2, 6, 3]), (2, [2, 5, 3])]  # a re-ingest under the same row id
    vectors, n = cache.embed(table(spark, changed), vocabulary, e)
    assert n == 1 and got(vectors) == got(V.embed(table(spark, changed), e))
    assert len(cache.generations()) == 3
    cache.forget()
    assert cache.generations() == [] and cache.embed(table(spark, rows), vocabulary, e)[1] == 2


def test_ingest_forgets(spark, path):
    vocabulary = spark.createDataFrame(VOCABULARY, "token string, id int")
    cache, e = EmbeddingCache(spark, f"{path}-cache", "cards"), V.HashedProjection(10, 4)
    cache.embed(table(spark, [(1, [2, 4, 3])]), vocabulary, e)
    target = targets.DataTarget("path", path)
    rows = spark.range(9).withColumn("split", F.element_at(F.array(*map(F.lit, (
        "train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")))
    assert targets.ingest_once(rows, target, then=cache.forget) and cache.generations() == []
    cache.embed(table(spark, [(1, [2, 4, 3])]), vocabulary, e)
    assert not targets.ingest_once(rows, target, then=cache.forget)
    assert len(cache.generations()) == 1 and np.isfinite(list(got(cache.embed(
        table(spark, [(1, [2, 4, 3])]), vocabulary, e)[0]).values())).all()


def test_a_vector_is_kept_once_however_many_rows_share_its_ids(spark, path):
    vocabulary = spark.createDataFrame(VOCABULARY, "token string, id int")
    cache, made = EmbeddingCache(spark, path, "cards"), V.HashedProjection(10, 4)
    rows = [(k, [2, 4 + k % 3, 3]) for k in range(90)]
    assert cache.embed(table(spark, rows[:30]), vocabulary, made)[1] == 30
    every, n = cache.embed(table(spark, rows), vocabulary, made)
    home = f"{path}/cards/n=all/{cache.generations()[0]}"
    kept = spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/vectors/data")
    assert n == 60 and kept.count() == 3
    assert got(every) == got(V.embed(table(spark, rows), made))


def test_the_cache_query_makes_its_ids_once(spark, monkeypatch):
    from types import SimpleNamespace

    from txnspark.operators import tokens as K
    from txnspark.operators import vectors as V
    from txnspark.plans import catalog
    from txnspark.plans import common as C
    from txnspark.plans import queries_models as Q
    folder, written = "/root/testdata/sf0.001", []
    vocabulary = K.fit_vocabulary(K.with_slots(C.features(spark, folder)))
    monkeypatch.setattr(Q, "trained", lambda *_: SimpleNamespace(bundle=SimpleNamespace(
        vocabulary=vocabulary, embedder=V.HashedProjection(vocabulary.count(), 16))))
    given = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: written.append(df.columns) or given(
        df, name))
    found = catalog.QUERIES["src_14_embedding_cache"](spark, folder).collect()
    assert ["row_id", "split", "ids"] in written
    ids = C.split_features(spark, folder).select("row_id", "split").collect()
    assert {(r["split"], r["cached"], r["reused"]) for r in found} == {
        (s, sum(r["split"] == s for r in ids),
         sum(r["split"] == s and r["row_id"] % 3 == 0 for r in ids))
        for s in {r["split"] for r in ids}}
