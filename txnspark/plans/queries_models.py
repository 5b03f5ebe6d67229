"""Registered learned transforms: encoding, PCA, embeddings, heads, diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.features import money_text
from txnspark.functions.rules import (AMOUNT_CEILING, AMOUNT_SCALE, HEAD_CLIP, ODD_HOUR_WEIGHT,
                                      ODD_HOURS, ONLINE_WEIGHT, STUB_BASE)
from txnspark.operators import encoders as E
from txnspark.operators import external as U
from txnspark.operators import external_fit as UF
from txnspark.operators import heads as H
from txnspark.operators import metrics as M
from txnspark.operators import token_vectors as TV
from txnspark.operators import tokens as K
from txnspark.operators import vectors as V
from txnspark.operators.embedding_cache import EmbeddingCache
from txnspark.operators.ordered import middle_rows
from txnspark.plans import common as C
from txnspark.plans import training as T
from txnspark.plans.oracle import events, rules, splits
from txnspark.plans.queries_features import SLOTS_SQL, VOCAB_SQL
from txnspark.plans.registry import query
from txnspark.plans.scoring import score_requests
from txnspark.session import materialize, new_path
from txnspark.sources.transactions import read_table

SPLIT_SQL = splits(S.TRAIN_CAP, S.EVAL_ROWS)
ROUNDS = {head: p.rounds for head, p in H.PARAMS.items()}


def trained(spark, folder) -> T.Training:
    return C.once(spark, folder, "trained", lambda: T.train_heads(
        C.split_features(spark, folder, dealt=True), None, ROUNDS, patience=H.STOP_PATIENCE))


def _test(spark, folder):
    # The latest dates may lie in one row group, and each of these rows is scored.
    return C.split_features(spark, folder, dealt=True).where(F.col("split") == "test")


def _code_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN CASE WHEN (SELECT count(*) FROM split_rows WHERE split "
            f"= 'train' AND {c} IS NULL) > 0 THEN NULL ELSE -1 END "
            f"ELSE coalesce(d_{c}.code, -1) END AS {c}_code")


def _dict_sql(c):
    return (f"d_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code"
            f" FROM (SELECT DISTINCT {c} FROM split_rows WHERE split = 'train' AND {c} IS NOT NULL))")


@query("mlx_01_ordinal_encoding", events(
    SPLIT_SQL + ", " + ", ".join(map(_dict_sql, S.TEXT_FEATURES)) + " SELECT row_id, "
    + ", ".join(map(_code_sql, S.TEXT_FEATURES)) + " FROM split_rows "
    + " ".join(f"LEFT JOIN d_{c} ON d_{c}.v = {c}" for c in S.TEXT_FEATURES)))
def _(spark, folder):
    rows = C.split_features(spark, folder)
    dictionary = E.fit_dictionary(rows.where(F.col("split") == "train"))
    return E.ordinal_encode(rows, dictionary).select(
        "row_id", *[f"{c}_code" for c in S.TEXT_FEATURES])


@query("mlx_02_pca_keeps_lengths", "WITH c AS (SELECT [" + ", ".join(
    f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + """] AS mid FROM embeddings)
SELECT vec_id, round(list_sum([(x::DOUBLE - mid[i]) ** 2 FOR x, i IN embedding]), 6) AS length2
FROM embeddings, c""")
def _(spark, folder):
    # With as many components as dimensions a centred rotation keeps every length.
    e = read_table(spark, folder, "embeddings")
    rotated = V.apply_pca(e, V.fit_pca(e, 64))
    return rotated.select("vec_id", F.round(V.dot("pca", "pca"), 6).alias("length2"))


@query("mlx_02_pca_invariants", """
SELECT range AS component, true AS centred, true AS falling, true AS uncorrelated
FROM range((SELECT max(len(embedding)) FROM embeddings))""")
def _(spark, folder):
    e = read_table(spark, folder, "embeddings")
    stats = V.mean_and_covariance(V.apply_pca(e, V.fit_pca(e, 64)), "pca")
    spread = stats.where("i = j").select(
        F.col("i").alias("component"), F.abs("mean_i").alias("mean"), F.col("cov").alias("var"),
        F.lag("cov").over(W.orderBy("i")).alias("before"))  # one row per component
    other = stats.where("i < j").groupBy(F.col("i").alias("_c")).agg(
        F.max(F.abs("cov")).alias("cross"))
    return spread.join(other, F.col("component") == F.col("_c"), "left").select(
        "component", (F.col("mean") < 1e-9).alias("centred"),
        F.coalesce(F.col("var") <= F.col("before") + 1e-12, F.lit(True)).alias("falling"),
        (F.coalesce("cross", F.lit(0.0)) < 1e-9).alias("uncorrelated"))


@query("mlx_03_embedding")
def _(spark, folder):
    t = trained(spark, folder)
    e = T.embedded(C.features(spark, folder), t.bundle.vocabulary, t.bundle.embedder)
    return e.select("row_id", V.sizes(F.col("embedding")).alias("s")).select(
        "row_id", F.col("s.dims").alias("dim"), F.round(F.sqrt("s.energy"), 4).alias("length"))


@query("mlx_03_embeddings_are_complete", events("""
SELECT row_id, CAST(512 AS INTEGER) AS dim, true AS finite FROM feat"""))
def _(spark, folder):
    t = trained(spark, folder)
    e = T.embedded(C.features(spark, folder), t.bundle.vocabulary, t.bundle.embedder)
    # NaN is above every number.
    return e.select("row_id", V.sizes(F.col("embedding")).alias("s")).select(
        "row_id", F.col("s.dims").alias("dim"), (F.col("s.largest") < 1e6).alias("finite"))


def _encoded(spark, folder):
    # Written once: the vocabulary, the pairs of tokens and the vectors all read the tokens.
    slots = materialize(K.with_slots(C.dealt_features(spark, folder)).select("row_id", *K.SLOTS),
                        "slots")
    return K.encode(slots, K.fit_vocabulary(slots))


@query("mlx_03_token_information", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="")},
 placed AS (SELECT row_id, unnest([{', '.join(f'v{i}.id' for i in range(6))}]) AS id,
   unnest(range(6)) AS place FROM slots """ + " ".join(
    f"JOIN vocab v{i} ON v{i}.token = {s}" for i, s in enumerate(K.SLOTS)) + """),
 pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM placed x JOIN placed y
   ON x.row_id = y.row_id AND x.place <> y.place GROUP BY ALL),
 single AS (SELECT a, sum(n) AS n FROM pairs GROUP BY a)
 SELECT CAST(p.a AS BIGINT) AS a, CAST(p.b AS BIGINT) AS b,
   round(ln(CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM pairs) / (CAST(s.n AS DOUBLE) * t.n)), 6)
   AS weight
 FROM pairs p JOIN single s ON s.a = p.a JOIN single t ON t.a = p.b
 WHERE ln(CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM pairs) / (CAST(s.n AS DOUBLE) * t.n)) > 0""")
def _(spark, folder):
    weights = TV.mutual_information(TV.cooccurrence(_encoded(spark, folder)))
    return weights.select("a", "b", F.round("weight", 6).alias("weight"))


@query("mlx_03_learned_embedding")
def _(spark, folder):
    encoded = _encoded(spark, folder)
    return V.embed(encoded, TV.learn_embedder(encoded))


@query("mlx_04_pooling", "SELECT vec_id, " + ", ".join(
    [f"round(embedding[{49 + i}]::DOUBLE, 6) AS last_{i}" for i in range(16)]
    + [f"round((embedding[{1 + i}]::DOUBLE + embedding[{17 + i}] + embedding[{33 + i}] "
       f"+ embedding[{49 + i}]) / 4, 6) AS mean_{i}" for i in range(16)]) + " FROM embeddings")
def _(spark, folder):
    states = F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])
    e = read_table(spark, folder, "embeddings").select("vec_id", states.alias("states")).select(
        "vec_id", V.last_state("states").alias("last"), V.mean_state("states", 16).alias("mean"))
    return e.select("vec_id", *[F.round(F.col(c)[i].cast("double"), 6).alias(f"{c}_{i}")
                                for c in ("last", "mean") for i in range(16)])


def _head_query(name, head):
    @query(name)
    def _(spark, folder):
        scores = trained(spark, folder).scores.where(F.col("head") == head)
        return M.ranking_metrics(scores, ["head"])


@query("mlx_13_heads_cover_the_test_split", events(SPLIT_SQL + """
 SELECT head, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg
 FROM split_rows, (VALUES ('raw'), ('embed'), ('combined')) h(head)
 WHERE split = 'test' GROUP BY head"""))
def _(spark, folder):
    m = M.ranking_metrics(trained(spark, folder).scores, ["head"])
    return m.select("head", "n_pos", "n_neg")


_head_query("mlx_05_raw_head", "raw")
_head_query("mlx_06_embedding_head", "embed")
_head_query("mlx_07_combined_head", "combined")


@query("mlx_10_validation_curve")
def _(spark, folder):
    return trained(spark, folder).curves.orderBy("head", "round")


@query("mlx_11_test_scores")
def _(spark, folder):
    t = trained(spark, folder)
    return t.bundle.score(_test(spark, folder)).select("row_id", "y", "p_raw", "p_embed",
                                                       "p_combined")


@query("mlx_11_scores_are_probabilities", events(SPLIT_SQL + """
 SELECT row_id, y, true AS raw, true AS embed, true AS combined
 FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    scored = trained(spark, folder).bundle.score(_test(spark, folder))
    return scored.select("row_id", "y", *[
        F.coalesce(F.col(f"p_{h}").between(0, 1), F.lit(False)).alias(h) for h in T.HEAD_NAMES])


@query("mlx_12_importances_add_up", """
SELECT CAST(77 AS BIGINT) AS features, CAST(13 AS BIGINT) AS raw, 1e0 AS total""")
def _(spark, folder):
    t, names = trained(spark, folder), T.feature_names()
    every = H.importances(t.bundle.heads["combined"], names, len(E.raw_feature_names()), spark,
                          top=len(names))
    return every.agg(F.count(F.lit(1)).alias("features"),
                     F.count_if(F.col("kind") == "raw").alias("raw"),
                     F.round(F.sum("importance"), 2).alias("total"))


def _importances(spark, folder, head="combined"):
    t = trained(spark, folder)
    names = T.feature_names()
    return H.importances(t.bundle.heads[head], names, len(E.raw_feature_names()), spark)


@query("mlx_12_importances")
def _(spark, folder):
    t = trained(spark, folder)
    names = T.feature_names()
    return H.importances(t.bundle.heads["combined"], names, len(E.raw_feature_names()), spark,
                         top=len(names))


@query("srt_01_top_features")
def _(spark, folder):
    return _importances(spark, folder)


@query("agg_21_embedding_features_in_top")
def _(spark, folder):
    return _importances(spark, folder).agg(
        F.count_if(F.col("kind") == "embedding").alias("embedding"),
        F.count(F.lit(1)).alias("shown"))


@query("mlx_13_heads_side_by_side")
def _(spark, folder):
    m = M.ranking_metrics(trained(spark, folder).scores, ["head"])
    return M.lift(m)


@query("mlx_14_diagnostics")
def _(spark, folder):
    t = trained(spark, folder)
    bins = M.score_histogram(t.scores.where(F.col("head") == "combined"))
    separation = F.array_sort(F.collect_list(F.struct("bin", "legit", "fraud")))
    curve = t.curves.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("round", "auc"))).alias("c"))
    return (bins.agg(F.to_json(separation).alias("separation"))
            .withColumn("curves", curve.agg(F.to_json(F.map_from_entries(
                F.collect_list(F.struct("head", "c"))))).scalar())
            .withColumn("importance", _importances(spark, folder).agg(F.to_json(F.collect_list(
                F.struct("name", "importance", "kind")))).scalar()))


def _saved(spark, folder):
    def build():
        path = new_path(spark, "bundle")
        trained(spark, folder).bundle.save(path)
        return path
    return C.once(spark, folder, "bundle-path", build)


@query("src_17_model_bundle", events(SPLIT_SQL + """
 SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    t, test = trained(spark, folder), _test(spark, folder)
    again = T.Bundle.load(spark, _saved(spark, folder))
    a = T.long_scores(t.bundle.score(test)).select("row_id", "head", "p")
    b = T.long_scores(again.score(test)).select("row_id", "head", F.col("p").alias("q"))
    return a.join(b, ["row_id", "head"]).agg(
        F.count_if(F.col("head") == "raw").alias("rows"),
        F.count_if(F.abs(F.col("p") - F.col("q")) > 1e-12).alias("changed"))


@query("mlx_15_bundle_scoring")
def _(spark, folder):
    bundle = T.Bundle.load(spark, _saved(spark, folder))
    wide = bundle.inputs(_test(spark, folder)).select(
        "row_id", "y", "raw", *[F.col("pca")[i].alias(f"pca_{i}") for i in range(S.PCA_DIM)])
    parts = S.component_columns(wide.columns)
    rows = wide.select("row_id", "y", "raw", F.array(*parts).alias("pca"))
    return H.score(bundle.heads["combined"], rows, "combined").select(
        "row_id", F.col("p").alias("probability"))


@query("mlx_15_bundle_equals_training", events(SPLIT_SQL + """
 SELECT row_id, true AS same FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    t = trained(spark, folder)
    now = T.Bundle.load(spark, _saved(spark, folder)).score(_test(spark, folder))
    then = t.scores.where(F.col("head") == "combined").select("row_id", "p")
    return now.join(then, "row_id").select(
        "row_id", (F.abs(F.col("p") - F.col("p_combined")) < 1e-9).alias("same"))


def _request_form(test):
    """(whether a row is one of the odd requests, the rows as request forms)."""
    # Every fifth request names its merchant and leaves the zip empty.
    odd = F.col("row_id") % 5 == 0
    form = test.select(
        "row_id", *[c for c in ("year", "month", "day", "time", "amount", "use_chip", "mcc",
                                "merchant_city", "merchant_state", "card", "user")],
        F.when(odd, "AMAZON").otherwise(F.col("merchant_name").cast("string"))
        .alias("merchant_name"),
        F.when(odd, "").otherwise(F.col("zip").cast("string")).alias("zip"))
    return odd, form


@query("jsn_01_trained_replies", events(SPLIT_SQL + """
 SELECT row_id, 'model' AS mode, CAST(8 AS INTEGER) AS tokens, CAST(512 AS INTEGER) AS dim,
   true AS in_range, true AS placed, true AS same FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    t, test = trained(spark, folder), _test(spark, folder)
    odd, form = _request_form(test)
    shape = ("mode string, tokens array<string>, embedding_dim int, scores struct<raw:double,"
             "embed:double,combined:double>, position struct<x:double,y:double>")
    replies = score_requests(form, t.bundle).select(
        F.col("row_id").alias("_id"), F.from_json("reply", shape).alias("r"))
    batch = t.bundle.score(test, "zip", "merchant_state").join(
        replies, F.col("row_id") == F.col("_id"))
    complete = ~odd & F.col("zip").isNotNull() & F.col("merchant_state").isNotNull()
    near = F.lit(True)
    for head in T.HEAD_NAMES:
        near = near & (F.abs(F.col(f"p_{head}") - F.col(f"r.scores.{head}")) < 1e-9)
    inside = lambda h: F.col(f"r.scores.{h}").between(0.0, 1.0)
    return batch.select(
        "row_id", "r.mode", F.size("r.tokens").alias("tokens"),
        F.col("r.embedding_dim").alias("dim"),
        (inside("raw") & inside("embed") & inside("combined")).alias("in_range"),
        (F.col("r.position.x").isNotNull() & F.col("r.position.y").isNotNull()).alias("placed"),
        (~complete | near).alias("same"))


def stub_frame_scorer(frame):
    """The stub rule on a raw frame: an external scorer for tests."""
    share = np.minimum(frame["amount_num"].to_numpy() / AMOUNT_SCALE, AMOUNT_CEILING)
    for hit, weight in ((frame["use_chip"].str.contains("online", case=False), ONLINE_WEIGHT),
                        (frame["hour"].between(*ODD_HOURS), ODD_HOUR_WEIGHT)):
        share = share + weight * hit.to_numpy(dtype=float)
    return np.clip(STUB_BASE + share, *HEAD_CLIP)


SCORER_COLUMNS = ["use_chip", "hour", "amount_num", "zip", "merchant_name"]


@query("mlx_16_external_scorer", rules("""
SELECT row_id, round(stub, 9) AS score, 'ok' AS status FROM rule"""))
def _(spark, folder):
    scored = U.external_scores(C.features(spark, folder), stub_frame_scorer, SCORER_COLUMNS)
    return scored.select("row_id", F.round("score", 9).alias("score"), "status")


@query("mlx_17_embedding_map")
def _(spark, folder):
    t = trained(spark, folder)
    return V.map_points(t.inputs.where(F.col("split") == "test")).select("row_id", "x", F.col("y_pos"), F.col("y").alias("fraud"))


@query("mlx_17_map_places_every_row", events(SPLIT_SQL + """
 SELECT row_id, y AS fraud, true AS placed FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    # Background points and live points come from the same operator.
    t = trained(spark, folder)
    background = V.map_points(t.inputs.where(F.col("split") == "test")).select(
        "row_id", F.col("x").alias("x0"), F.col("y_pos").alias("y0"))
    live = t.bundle.score(_test(spark, folder)).select("row_id", "y", "x", "y_pos")
    gap = V.euclidean(F.col("x"), F.col("y_pos"), F.col("x0"), F.col("y0"))
    return live.join(background, "row_id").select(
        "row_id", F.col("y").alias("fraud"), (gap < 1e-4).alias("placed"))


@query("joi_06_batch_and_live_positions", events(SPLIT_SQL + """
 SELECT row_id, true AS placed, true AS same FROM split_rows WHERE split = 'test'"""))
def _(spark, folder):
    # The background map's point of each row beside the point its request is answered with.
    t, test = trained(spark, folder), _test(spark, folder)
    odd, form = _request_form(test)
    shape = "position struct<x:double,y:double>"
    live = score_requests(form, t.bundle).select(
        F.col("row_id").alias("_id"), F.from_json("reply", shape)["position"].alias("p"))
    batch = V.map_points(t.inputs.where(F.col("split") == "test")).select("row_id", "x", "y_pos")
    drift = V.euclidean(F.col("x"), F.col("y_pos"), F.col("p.x"), F.col("p.y"))
    complete = ~odd & F.col("zip").isNotNull() & F.col("merchant_state").isNotNull()
    whole = test.select(F.col("row_id").alias("_row"), complete.alias("complete"))
    pairs = batch.join(live, F.col("row_id") == F.col("_id")).join(
        whole.withColumnRenamed("_row", "_w"), F.col("row_id") == F.col("_w"))
    return pairs.select("row_id", drift.isNotNull().alias("placed"),
                        (~F.col("complete") | (drift < 1e-4)).alias("same"))


@query("mlx_18_examples_on_the_map", events(SPLIT_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS i,
   count(*) OVER (PARTITION BY y) AS n FROM split_rows WHERE split = 'test')
SELECT row_id, y = 1 AS is_fraud, true AS placed, true AS on_background FROM r WHERE i = n // 2"""))
def _(spark, folder):
    t, test = trained(spark, folder), _test(spark, folder)
    picked = middle_rows(test, ["row_id"], "y")
    live = t.bundle.score(picked).select("row_id", "y", "x", "y_pos")
    background = V.map_points(t.inputs.where(F.col("split") == "test")).select(
        F.col("row_id").alias("_id"), F.col("x").alias("x0"), F.col("y_pos").alias("y0"))
    gap = V.euclidean(F.col("x"), F.col("y_pos"), F.col("x0"), F.col("y0"))
    return live.join(background, F.col("row_id") == F.col("_id")).select(
        "row_id", (F.col("y") == 1).alias("is_fraud"), gap.isNotNull().alias("placed"),
        (gap < 1e-4).alias("on_background"))


@query("mlx_18_examples", events(SPLIT_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS i,
   count(*) OVER (PARTITION BY y) AS n FROM split_rows WHERE split = 'test')
SELECT ordinal, label, row_id, y = 1 AS is_fraud,
  '$' || CAST(CAST(amount_num AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  CAST(merchant_name AS VARCHAR) AS merchant_name, use_chip, merchant_city, merchant_state, zip,
  mcc, "year", "month", "day", "time", card, "user"
FROM r JOIN (VALUES (1, 'Real fraud (test set)', 1), (2, 'Real legitimate (test set)', 0),
  (3, 'Real fraud #2 (test set)', 1)) v(ordinal, label, want) ON y = want WHERE i = n // 2"""))
def _(spark, folder):
    slots = F.when(F.col("y") == 1, F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit("Real fraud (test set)").alias("label")),
        F.struct(F.lit(3).alias("ordinal"), F.lit("Real fraud #2 (test set)").alias("label")),
    )).otherwise(F.array(F.struct(F.lit(2).alias("ordinal"),
                                  F.lit("Real legitimate (test set)").alias("label"))))
    picked = middle_rows(_test(spark, folder), ["row_id"], "y")
    return picked.select(
        F.inline(slots), "row_id", (F.col("y") == 1).alias("is_fraud"),
        money_text(F.col("amount_num")).alias("amount"),
        F.col("merchant_name").cast("string").alias("merchant_name"), "use_chip",
        "merchant_city", "merchant_state", "zip", "mcc", "year", "month", "day", "time", "card",
        "user")


@query("win_08_explained_variance")
def _(spark, folder):
    model = V.fit_pca(read_table(spark, folder, "embeddings"), 32)
    return spark.createDataFrame(V.explained_variance(model),
                                 "component int, share double, cumulative double")


@query("win_08_variance_of_two_components", """
WITH c AS (SELECT var_samp(embedding[1]::DOUBLE) AS a, var_samp(embedding[2]::DOUBLE) AS b,
  covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS k FROM embeddings),
r AS (SELECT a + b AS total, sqrt((a - b) ** 2 + 4 * k ** 2) AS spread FROM c)
SELECT CAST(1 AS INTEGER) AS component, round((total + spread) / 2 / total, 9) AS share,
  round((total + spread) / 2 / total, 9) AS cumulative FROM r
UNION ALL SELECT 2, round((total - spread) / 2 / total, 9), 1e0 FROM r""")
def _(spark, folder):
    # Two dimensions have a closed form.
    e = read_table(spark, folder, "embeddings").select(F.slice("embedding", 1, 2).alias(
        "embedding"))
    rows = V.explained_variance(V.fit_pca(e, 2))
    table = spark.createDataFrame(rows, "component int, share double, cumulative double")
    return table.withColumns({c: F.round(c, 9) for c in ("share", "cumulative")})


@query("win_08_variance_of_all_components", f"""
WITH x AS (SELECT embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT i.range + 1 AS i, j.range + 1 AS j FROM range(64) i, range(64) j),
c AS (SELECT i, j, covar_samp(v[i], v[j]) AS cov FROM x, p GROUP BY i, j)
SELECT CAST(64 AS BIGINT) AS components, 1e0 AS cumulative,
  round(sum(cov * cov) / (sum(CASE WHEN i = j THEN cov END)) ** 2, 9) AS squares FROM c""")
def _(spark, folder):
    # The squared shares of all components add up to the squared covariances.
    e = read_table(spark, folder, "embeddings")
    rows = V.explained_variance(V.fit_pca(e, 64))
    table = spark.createDataFrame(rows, "component int, share double, cumulative double")
    return table.agg(F.count(F.lit(1)).alias("components"),
                     F.round(F.max("cumulative"), 9).alias("cumulative"),
                     F.round(F.sum(F.col("share") * F.col("share")), 9).alias("squares"))


@query("src_14_embedding_cache", events(SPLIT_SQL + """
 SELECT split, count(*) AS cached, count(*) FILTER (row_id % 3 = 0) AS reused
 FROM split_rows GROUP BY split"""))
def _(spark, folder):
    t = trained(spark, folder)
    # The ids are read by every step below, so they are made once.
    rows = materialize(K.encode(K.with_slots(C.split_features(spark, folder)), t.bundle.vocabulary)
                       .select("row_id", "split", "ids"), "encoded")
    path = new_path(spark, "embedding-cache/n=all")
    small = V.HashedProjection(t.bundle.embedder.vocabulary, 16)
    first = V.embed_cached(rows.where("row_id % 3 = 0"), small, path)
    before = materialize(first.select("row_id", F.lit(1).alias("hit")), "first-pass")
    every = V.embed_cached(rows, small, path)
    return (every.select("row_id").join(rows.select("row_id", "split"), "row_id")
            .join(before, "row_id", "left").groupBy("split").agg(
                F.count(F.lit(1)).alias("cached"), F.count("hit").alias("reused")))


@query("src_14_versioned_cache", events(SPLIT_SQL + """
 SELECT split, count(*) AS cached, count(*) FILTER (row_id % 3 <> 0) AS computed,
   CAST(0 AS BIGINT) AS changed FROM split_rows GROUP BY split"""))
def _(spark, folder):
    # A third of the rows is cached, then all; then another vocabulary, which reuses nothing.
    t, rows = trained(spark, folder), C.split_features(spark, folder)
    slots = K.with_slots(rows)
    encoded = K.encode(slots, t.bundle.vocabulary).select("row_id", "split", "ids")
    cache = EmbeddingCache(spark, new_path(spark, "vectors"), "events")
    vectors = lambda d, v: cache.embed(d, v, t.bundle.embedder)
    first, _ = vectors(encoded.where("row_id % 3 = 0"), t.bundle.vocabulary)
    known = materialize(first.select(F.col("row_id").alias("_known")), "first-pass")
    every, _ = vectors(encoded, t.bundle.vocabulary)
    turned = t.bundle.vocabulary.withColumn("token", F.reverse("token"))
    _, again = vectors(encoded, turned)
    n = encoded.count()
    pairs = every.select("row_id", F.size("embedding").alias("dim")).join(
        encoded.select("row_id", "split"), "row_id").join(
        known, F.col("row_id") == F.col("_known"), "left")
    return pairs.where("dim = 512").groupBy("split").agg(
        F.count(F.lit(1)).alias("cached"), F.count_if(F.col("_known").isNull()).alias("computed"),
        F.lit(n - again).cast("long").alias("changed"))


# ---- plug points -----------------------------------------------------------------------


class RuleModel(U.FrameModel):
    """A pluggable model that loads its weights from the context."""

    def load_context(self, context):
        self.base = context["base"]

    def predict(self, frame):
        return stub_frame_scorer(frame) - STUB_BASE + self.base


@query("udf_01_frame_model", rules("""
SELECT row_id, round(greatest(least(0.24e0 + s_on + s_odd + s_amt, 0.99), 0.01) - 0.24e0 + 0.2e0, 9)
  AS prediction FROM rule"""))
def _(spark, folder):
    scored = U.apply_model(C.features(spark, folder), RuleModel(), {"base": 0.2}, SCORER_COLUMNS)
    return scored.select("row_id", F.round("prediction", 9).alias("prediction"))


def predict_rows(args: dict) -> dict:
    """A request function: probability grows with the amount."""
    return {"probability": [min(r["amount_num"] / 1000.0, 1.0) for r in args["rows"]]}


@query("udf_02_scoring_function", events(
    "SELECT row_id, round(least(amount_num / 1000, 1), 9) AS probability FROM feat"))
def _(spark, folder):
    f = C.features(spark, folder)
    p = U.scoring_function(predict_rows, ["amount_num", "mcc"])
    return f.select("row_id", F.round(p, 9).alias("probability"))


def half_broken_scorer(frame):
    if (frame["hour"] >= 24).any():
        raise ConnectionError("unreachable")
    return np.full(len(frame), 0.5)


@query("udf_03_external_transport", events("""
SELECT 'ok' AS status, count(*) AS n, count(*) * 0.5e0 AS total FROM feat
UNION ALL SELECT 'unavailable', count(*), NULL FROM feat"""))
def _(spark, folder):
    f = C.features(spark, folder)
    fine = U.external_scores(f, half_broken_scorer, SCORER_COLUMNS)
    down = U.external_scores(f.withColumn("hour", F.lit(24)), half_broken_scorer,
                             SCORER_COLUMNS)
    return fine.unionByName(down).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def channel_rates(train, val):
    """A learner: the fraud rate of each channel among its train rows."""
    rows = pd.concat(train)
    rates, usual = rows.groupby("use_chip")["y"].mean(), rows["y"].mean()
    return lambda frame: frame["use_chip"].map(rates).fillna(usual).to_numpy()


@query("udf_03_external_fit", events(SPLIT_SQL + """,
 rate AS (SELECT use_chip, avg(y) AS p FROM split_rows WHERE split = 'train' GROUP BY use_chip)
 SELECT row_id, round(p, 9) AS score, 'ok' AS status, true AS fitted
 FROM split_rows JOIN rate USING (use_chip) WHERE split = 'test'"""))
def _(spark, folder):
    rows = C.split_features(spark, folder)
    train, val, test = (rows.where(F.col("split") == s) for s in S.SPLITS)
    n = train.count()
    fit = UF.fit_external(train, val, test, channel_rates, ["use_chip"], rows=n)
    scored = U.external_scores(test, fit.scorer, ["use_chip"], timeout_s=60)
    whole = fit.meta.select((F.col("n_train") == n) & (F.col("scored") == F.col("n_test")) & (
        F.col("test_auc") >= 0.5)).scalar()
    return scored.select("row_id", F.round("score", 9).alias("score"), "status",
                         whole.alias("fitted"))


def sum_embedder(ids):
    """A user embedder: id sum, largest id, number of tokens."""
    return np.stack([ids.sum(axis=1), ids.max(axis=1), (ids > 0).sum(axis=1)], axis=1)


@query("udf_04_user_embedder", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="")}
 SELECT row_id, CAST({' + '.join(f'v{i}.id' for i in range(6))} + 5 AS INTEGER) AS id_sum,
  CAST(greatest({', '.join(f'v{i}.id' for i in range(6))}) AS INTEGER) AS id_max,
  CAST(8 AS INTEGER) AS tokens FROM slots """ + " ".join(
    f"JOIN vocab v{i} ON v{i}.token = {s}" for i, s in enumerate(K.SLOTS)))
def _(spark, folder):
    slots = K.with_slots(C.features(spark, folder))
    e = V.embed(K.encode(slots, K.fit_vocabulary(slots)), sum_embedder)
    at = lambda i: F.col("embedding")[i].cast("int")
    return e.select("row_id", at(0).alias("id_sum"), at(1).alias("id_max"), at(2).alias("tokens"))
