"""Learned transforms, plug points and streams on small frames."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnspark.functions.hashing import normal_number
from txnspark.operators import encoders as E
from txnspark.operators import external as U
from txnspark.operators import heads as H
from txnspark.operators import vectors as V
from txnspark.plans import training as T
from txnspark.plans import common as C
from txnspark.streaming import jobs


def test_ordinal_codes(spark):
    train = spark.createDataFrame([("b", "x"), ("a", None), ("b", "x")], "p string, q string")
    new = spark.createDataFrame([("a", None), ("c", "x"), (None, "z")], "p string, q string")
    d = E.fit_dictionary(train, ["p", "q"])
    got = sorted(map(tuple, E.ordinal_encode(new, d, ["p", "q"]).select(
        "p", "q", "p_code", "q_code").collect()), key=str)
    assert got == sorted([("a", None, 0.0, None), ("c", "x", -1.0, 0.0),
                          (None, "z", -1.0, -1.0)], key=str)


def vectors(spark, n=400, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) * np.arange(dim, 0, -1) + 5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "row_id long, embedding array<float>")
    return df, x.astype(float)


def test_pca_equals_eigenvectors(spark):
    df, x = vectors(spark)
    model = V.fit_pca(df, 4)
    got = np.array([r["pca"] for r in V.apply_pca(df, model).orderBy("row_id").collect()])
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)])
    assert np.allclose(got, centred @ vt[:4].T * signs, atol=1e-4)
    shares = [s for _, s, _ in V.explained_variance(model)]
    assert shares == sorted(shares, reverse=True)


def test_pca_is_fitted_on_train_only(spark):
    df, x = vectors(spark)
    model = V.fit_pca(df.where("row_id < 100"), 2)
    mean = np.array([r["pca"] for r in V.apply_pca(df.where("row_id < 100"), model).collect()])
    assert np.allclose(mean.mean(axis=0), 0, atol=1e-6)
    rest = np.array([r["pca"] for r in V.apply_pca(df.where("row_id >= 100"), model).collect()])
    assert not np.allclose(rest.mean(axis=0), 0, atol=1e-6)


def test_embedding_column_equals_embedding_table(spark):
    df = spark.createDataFrame([(i, [2, 4 + i % 5, 3] + [0] * 5) for i in range(1500)],
                               "row_id long, ids array<int>")
    e = V.HashedProjection(20, 16)
    table = {r["row_id"]: r["embedding"] for r in V.embed(df, e).collect()}
    column = {r["row_id"]: r["v"] for r in df.select(
        "row_id", V.embedding_column(e, F.col("ids")).alias("v")).collect()}
    want = e(np.array([[2, 4 + i % 5, 3] + [0] * 5 for i in range(1500)]))
    assert table == column and np.allclose([table[i] for i in range(1500)], want)


def test_cache_embeds_only_missing_rows(spark, path):
    df = spark.createDataFrame([(i, [2, 4, 3]) for i in range(50)], "row_id long, ids array<int>")
    V.embed_cached(df.where("row_id < 20"), lambda ids: np.zeros((len(ids), 2)), path)
    got = V.embed_cached(df.where("row_id >= 10"), lambda ids: np.ones((len(ids), 2)), path)
    values = {r["row_id"]: r["embedding"][0] for r in got.collect()}
    assert set(values) == set(range(10, 50))
    assert all(v == (0.0 if k < 20 else 1.0) for k, v in values.items())
    assert spark.read.parquet(path).count() == 50


def test_vector_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "pca_0 double, pca_1 double, pca_2 double")
    packed = V.columns_to_vector(df, df.columns, "v").select("v")
    assert tuple(V.vector_to_columns(packed, "v", 3).drop("v").first()) == (1.0, 2.0, 3.0)


def test_cosine_of_a_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [-2.0, 0.0])],
                               "a array<double>, z array<double>, b array<double>")
    assert tuple(df.select(V.cosine("a", "z"), V.cosine("a", "b")).first()) == (None, -1.0)


# ---- heads -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table_rows(spark):
    """Transactions of the given events, split by row number."""
    split = (F.when(F.col("row_id") % 10 < 7, "train").when(F.col("row_id") % 10 < 8, "val")
             .otherwise("test"))
    return C.features(spark, "/root/testdata/sf0.01").withColumn("split", split)


def test_embedding_head_beats_raw_on_a_factor_it_alone_sees(spark, table_rows):
    # The label is the weekday group, which no raw feature shows.
    weekend = (F.dayofweek(F.make_date("year", "month", "day")) % 3 == 0).cast("int")
    labelled = table_rows.withColumn("y", weekend)
    signals = [weekend.cast("double"), F.log1p("amount_num"), F.col("hour") / 24.0]
    rows = labelled.withColumn("embedding", V.linear_map(signals, 16))
    d = E.fit_dictionary(rows.where("split = 'train'"))
    inputs = E.with_raw_features(rows, d)
    pca = V.fit_pca(inputs.where("split = 'train'"), 3)
    inputs = V.apply_pca(inputs, pca).select("row_id", "y", "split", "raw", "pca").cache()
    from txnspark.operators.metrics import lift, ranking_metrics
    parts = []
    for head in T.HEAD_NAMES:
        model = H.fit(head, inputs.where("split = 'train'"), rounds=8, depth=4)
        parts.append(H.score(model, inputs.where("split = 'test'"), head))
    scores = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert scores.where((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
    m = {r["head"]: r for r in lift(ranking_metrics(scores, ["head"])).collect()}
    assert m["embed"]["auc"] > m["raw"]["auc"] + 0.05
    assert m["combined"]["auc"] > m["raw"]["auc"] + 0.05 and m["embed"]["ap_lift_pct"] > 0


def test_last_stage_equals_the_model(spark, table_rows):
    d = E.fit_dictionary(table_rows)
    rows = E.with_raw_features(table_rows, d).cache()
    model = H.fit("raw", rows, rounds=4, depth=3)
    staged = H.staged_scores(model, H.with_features(rows, "raw")).where("round = 4")
    both = staged.join(H.score(model, rows, "raw").select("row_id", F.col("p").alias("q")),
                       "row_id")
    assert both.count() == 10_000
    assert both.where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0
    names = E.raw_feature_names()
    top = H.importances(model, names, len(names), spark, top=5).collect()
    assert len(top) == 5 and {r["kind"] for r in top} == {"raw"}


def test_rounds_are_staged_in_parts(spark, table_rows, monkeypatch):
    rows = E.with_raw_features(table_rows, E.fit_dictionary(table_rows)).where(
        "row_id < 2000").cache()
    model, ready = H.fit("raw", rows, rounds=5, depth=3), H.with_features(rows, "raw")
    whole = {tuple(r) for r in H.eval_curve(model, ready).collect()}
    monkeypatch.setattr(H, "STAGE_TREES", 2)
    parts = {tuple(r) for r in H.eval_curve(model, ready).collect()}
    assert sorted(n for n, _ in whole) == [1, 2, 3, 4, 5]
    assert {n: round(a, 9) for n, a in whole} == {n: round(a, 9) for n, a in parts}


@pytest.mark.parametrize("patience", [1, 2, 20])
def test_a_fit_that_grows_equals_one_of_all_rounds(spark, table_rows, monkeypatch, patience):
    rows = E.with_raw_features(table_rows, E.fit_dictionary(table_rows)).where(
        "row_id < 2000").cache()
    val = table_rows.sparkSession.createDataFrame([], rows.schema).unionByName(
        rows.where("row_id % 2 = 0"))
    long = lambda: H.fit_with_early_stop("raw", rows, val, 7, 3, patience)
    model, curve, best = long()
    monkeypatch.setattr(H, "FIRST_ROUNDS", 2)
    again, short, found = long()
    values = lambda c: {r["round"]: round(r["auc"], 9) for r in c.collect()}
    assert found == best == len(again.treeWeights) and values(short) == values(curve)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [
        t.toDebugString.split("\n", 1)[1] for t in model.trees]
    last = max(values(curve))  # training goes on until patience or rounds run out
    assert last == min(7, best + patience)


def test_first_trees_equal_a_shorter_fit_on_any_layout(spark, table_rows):
    rows = E.with_raw_features(table_rows, E.fit_dictionary(table_rows)).where(
        "row_id < 3000").cache()
    p = lambda m: {r["row_id"]: r["p"] for r in H.score(m, rows, "raw").collect()}
    cut = p(H.first_trees(H.fit("raw", rows, rounds=5, depth=3), 3))
    assert cut == p(H.fit("raw", rows.repartition(13), rounds=3, depth=3))


# ---- plug points -----------------------------------------------------------------------


def frames(spark, n=40):
    return C.features(spark, "/root/testdata/sf0.001").where(F.col("row_id") < n)


def status(df):
    return {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}


def test_external_contract(spark):
    f = frames(spark)
    ok = U.external_scores(f, lambda d: np.full(len(d), 0.25), timeout_s=30)
    assert ok.where("status = 'ok' AND score = 0.25 AND latency_ms >= 0").count() == 40
    assert status(U.external_scores(f, lambda d: np.full(len(d), 1.5), timeout_s=30)) == {
        "unavailable": 40}
    assert status(U.external_scores(f, lambda d: np.zeros(1), timeout_s=30)) == {
        "unavailable": 40}

    def slow(d):
        time.sleep(1.5)
        return np.zeros(len(d))
    late = U.external_scores(f.coalesce(1), slow, timeout_s=0.3)
    assert status(late) == {"timeout": 40} and late.where("score IS NULL").count() == 40
    assert U.external_training_rows(f, 7).count() == 7


# ---- streams ---------------------------------------------------------------------------


def card_rows(spark, times, first=0):
    rows = [(first + i, 1, 1, f"2024-01-01 {t}") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "row_id long, user long, card long, t string").select(
        "row_id", "user", "card", F.col("t").cast("timestamp").alias("ts"))


def test_gap_stream_resumes_reorders_and_drops_late_rows(spark, path):
    def land(times, first):
        chunk = card_rows(spark, times, first)
        chunk.write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", chunk.schema)
        jobs.gap_stream(stream, f"{path}/out", f"{path}/state", f"{path}/ck",
                        delay_s=600).awaitTermination()

    land(["10:00:00", "10:30:00"], 0)
    land(["10:25:00", "10:31:00", "09:00:00"], 10)  # out of order, in order, too late
    got = {r["row_id"]: r["time_delta_s"] for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {0: None, 1: 1800.0, 10: 1500.0, 11: 60.0}


def test_gap_stream_lands_late_rows_as_the_batch_has_them(spark, path):
    chunks = [(["10:00:00", "10:30:00"], 0), (["08:00:00", "10:25:00", "12:00:00"], 10),
              (["07:00:00", "09:00:00"], 20)]
    for times, first in chunks:
        chunk = card_rows(spark, times, first)
        chunk.write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", chunk.schema)
        jobs.gap_stream(stream, f"{path}/out", f"{path}/state", f"{path}/ck").awaitTermination()
    got = {r["row_id"]: r["time_delta_s"]
           for r in jobs.landed_gaps(spark, f"{path}/out", chunk.schema).collect()}
    assert got == {20: None, 10: 3600.0, 21: 3600.0, 0: 3600.0, 11: 1500.0, 1: 300.0, 12: 5400.0}


def test_unique_landing_admits_late_rows_and_drops_repeats(spark, path):
    def land(ids):
        chunk = spark.createDataFrame([(i, f"v{i}") for i in ids], "row_id long, v string")
        chunk.write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", chunk.schema)
        jobs.land_unique(stream, f"{path}/out", f"{path}/ck").awaitTermination()

    for ids in ([5, 6, 6], [1, 5], [6, 2, 2, 1], [5]):
        land(ids)
    assert sorted(r["row_id"] for r in spark.read.parquet(f"{path}/out").collect()) == [1, 2, 5, 6]


def test_replayed_batch_changes_nothing(spark, path):
    df = card_rows(spark, ["10:00:00", "10:01:00"])
    for _ in range(2):
        jobs.write_batch(df, path, 0)
    assert spark.read.parquet(path).count() == 2


def test_embedding_of_ragged_and_empty_batches(spark):
    df = spark.createDataFrame([(1, [2, 4, 3]), (2, [5]), (3, [2, 4, 5, 6, 3])],
                               "row_id long, ids array<int>")
    count = lambda ids: np.stack([ids.sum(axis=1), (ids > 0).sum(axis=1)], axis=1)
    got = {r["row_id"]: r["embedding"] for r in V.embed(df.coalesce(1), count).collect()}
    assert got == {1: [9.0, 3.0], 2: [5.0, 1.0], 3: [20.0, 5.0]}
    assert V.embed(df.where("row_id > 9"), count).count() == 0


def test_linear_map_reads_a_signal_once_a_row(spark):
    df = spark.range(3).select(F.col("id"), F.format_string('{"k": %d}', F.col("id")).alias("props"))
    k = F.get_json_object("props", "$.k").cast("int")
    mapped = df.select("id", V.linear_map([F.when(k < 2, k + 1.0), k * 2.0], 8).alias("v"))
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" in plan and "lambda" not in plan  # nothing is parsed for each component
    rows = {r["id"]: r["v"] for r in mapped.collect()}
    w = [[normal_number(f"{i}.{j}", "projection") for j in range(8)] for i in range(2)]
    for i in (0, 1):
        assert np.allclose(rows[i], [(i + 1) * a + 2 * i * b for a, b in zip(*w)], atol=1e-12)
    assert rows[2] == [None] * 8
    sums = df.select("id", V.component_sums(F.array(F.lit(1.0), F.lit(-2.0))).alias("s")).first()["s"]
    assert tuple(sums) == (2, -1.0, 5.0, -3.0)


def test_components_without_embeddings(spark, monkeypatch):
    # Fit and rotation from ids alone equal those of the embeddings, in any batch.
    rows = [(i, [2, 4 + i % 7, 11 + i % 5, 16 + i * i % 3, 3][:3 + i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>")
    embedder = V.HashedProjection(20, 24)
    vectors = V.embed(df, embedder)
    a, b = V.fit_pca(vectors, 3), V.fit_pca_of_ids(df, embedder, 3)
    assert np.allclose([x[1] for x in V.explained_variance(a)],
                       [x[1] for x in V.explained_variance(b)], atol=1e-6)
    want = {r["row_id"]: r["pca"] for r in V.apply_pca(vectors, a).collect()}
    placed = lambda d: {r["row_id"]: r["pca"] for r in d.select(
        "row_id", V.project_ids(embedder, b, F.col("ids")).alias("pca")).collect()}
    got = placed(df)
    assert all(np.allclose(got[i], want[i], atol=1e-5) for i in want)
    assert placed(df.orderBy(F.desc("row_id")).repartition(7)) == got


def test_training_writes_no_embeddings(spark, table_rows, monkeypatch):
    written = []
    given = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: written.extend(df.columns) or given(df, name))
    T.train_heads(table_rows.where("row_id % 4 = 0"), None, 1, 2, components=3, dim=16)
    assert "ids" in written and "embedding" not in written


def test_fits_share_one_layout_of_their_rows(spark, monkeypatch):
    dealt = []
    layout = H.laid_out
    monkeypatch.setattr(H, "laid_out", lambda *a: dealt.append(a) or layout(*a))
    rows = C.split_features(spark, "/root/testdata/sf0.001")
    t = T.train_heads(rows, None, 2, 3, components=4, dim=16)
    assert len(dealt) == 1
    # The rows that are dealt hold ids, not components, and the trees are those of a fit alone.
    assert "pca" not in dealt[0][0].columns
    alone = H.fit("combined", t.inputs.where("split = 'train'"), rounds=2, depth=3,
                  parts=H.fit_parts(rows.count()))
    kept = t.bundle.heads["combined"]
    assert H.first_trees(alone, kept.getNumTrees).toDebugString.split("\n")[1:] == (
        kept.toDebugString.split("\n")[1:])


def test_sizes_of_vectors(spark):
    rows = [(0, [3.0, -4.0]), (1, []), (2, None), (3, [1.0, None]), (4, [float("nan"), 2.0]),
            (5, [-1e7, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(1)
    got = {r["id"]: r["s"] for r in df.select("id", V.sizes(F.col("v")).alias("s")).collect()}
    assert tuple(got[0]) == (2, 25.0, 4.0) and tuple(got[1]) == (0, 0.0, 0.0)
    assert tuple(got[2]) == (None, None, None) and tuple(got[3]) == (2, None, None)
    assert np.isnan(got[4]["largest"]) and tuple(got[5]) == (2, 1e14, 1e7)


@pytest.mark.parametrize("name", ["mlx_03_embedding", "mlx_03_embeddings_are_complete"])
def test_embeddings_are_not_measured_by_lambdas(spark, monkeypatch, name):
    from types import SimpleNamespace

    from txnspark.operators import tokens as K
    from txnspark.plans import catalog
    from txnspark.plans import queries_models as Q
    folder = "/root/testdata/sf0.001"
    vocabulary = K.fit_vocabulary(K.with_slots(C.features(spark, folder)))
    bundle = T.Bundle({}, vocabulary, V.HashedProjection(vocabulary.count(), 512), None)
    monkeypatch.setattr(Q, "trained", lambda *_: SimpleNamespace(bundle=bundle))
    found = catalog.QUERIES[name](spark, folder)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    e = T.embedded(C.features(spark, folder), vocabulary, bundle.embedder)
    want = {r["row_id"]: r["l"] for r in e.select("row_id", F.round(F.sqrt(
        V.dot("embedding", "embedding")), 4).alias("l")).collect()}
    rows = found.collect()
    assert len(rows) == len(want) and all(r["dim"] == 512 for r in rows)
    assert all(r["length"] == want[r["row_id"]] if "length" in r else r["finite"] for r in rows)
