"""Registered aggregates: date counts, splits, metrics, histograms, map extent."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.operators import metrics as M
from txnspark.operators.quantiles import exact_quantiles
from txnspark.operators.splits import date_counts, fraud_rate, split_plan
from txnspark.plans import common as C
from txnspark.plans import ingest
from txnspark.plans.oracle import events, rnd, rules, splits
from txnspark.plans.registry import query
from txnspark.sources.transactions import read_table

# Caps of the registered ingest runs, low enough that thinning happens at test scale;
# date counts, cut-offs and the filter still read every row.
TRAIN_CAP, EVAL_ROWS = 4000, 600

ROUND_RATES = ("round(keep_train, 9) AS keep_train, round(keep_val, 9) AS keep_val, "
               "round(keep_test, 9) AS keep_test")
CURVE = """, grp AS (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {by}, p),
cumul AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER t AS np,
    sum(neg) OVER t AS nn FROM grp
    WINDOW w AS (PARTITION BY {by} ORDER BY p DESC), t AS (PARTITION BY {by})),
met AS (SELECT {by}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
    sum(neg * (cp - pos / 2e0)) / nullif(sum(pos) * sum(neg), 0) AS auc,
    sum(pos * (cp::DOUBLE / (cp + cn))) / nullif(sum(pos), 0) AS ap FROM cumul GROUP BY {by})"""
TEST_SCORES = splits(1000000, 100000) + """,
test_rows AS (SELECT row_id FROM split_rows WHERE split = 'test'),
test_scores AS (SELECT scores.* FROM scores SEMI JOIN test_rows USING (row_id))"""


@query("agg_01_rows_per_date", events("SELECT d, count(*) AS n FROM feat GROUP BY d"))
def _(spark, folder):
    return date_counts(C.features(spark, folder))


@query("agg_02_rows_per_split", events(splits(TRAIN_CAP, EVAL_ROWS)
       + " SELECT train_cut, test_cut, total, n_train, n_val, n_test FROM plan"))
def _(spark, folder):
    return split_plan(C.features(spark, folder)).select(
        "train_cut", "test_cut", "total", "n_train", "n_val", "n_test")


@query("agg_03_sampling_rates", events(splits(TRAIN_CAP, EVAL_ROWS)
       + f" SELECT {ROUND_RATES} FROM plan"))
def _(spark, folder):
    plan = split_plan(C.features(spark, folder), train_cap=TRAIN_CAP, eval_rows=EVAL_ROWS)
    return plan.select(*[F.round(c, 9).alias(c) for c in ("keep_train", "keep_val", "keep_test")])


@query("agg_04_fraud_rate_per_split", events(splits(TRAIN_CAP, EVAL_ROWS)
       + """, per AS (SELECT 'kept' AS part, split, y FROM sampled
             UNION ALL SELECT 'all', split, y FROM split_rows)
             SELECT part, split, count(*) AS n, round(avg(y::DOUBLE) * 100, 9) AS fraud_pct
             FROM per GROUP BY part, split"""))
def _(spark, folder):
    kept = ingest.split_and_sample(C.load_transactions(spark, folder), TRAIN_CAP, EVAL_ROWS)
    both = kept.select("split", "y", F.lit("kept").alias("part")).unionByName(
        C.split_features(spark, folder).select("split", "y", F.lit("all").alias("part")))
    return fraud_rate(both, "part", "split").withColumn("fraud_pct", F.round("fraud_pct", 9))


@query("agg_05_class_balance", events("SELECT y, count(*) AS n FROM feat GROUP BY y"))
def _(spark, folder):
    return C.features(spark, folder).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


HISTOGRAM = """, sc AS (SELECT y, p FROM scores WHERE head = 'combined'),
edges AS (SELECT CAST(range AS INTEGER) AS bin, range * (1e0/30) AS lo,
   CASE WHEN range = 29 THEN 2e0 ELSE (range + 1) * (1e0/30) END AS hi FROM range(30)),
hist AS (SELECT bin, round(bin / 30e0, 3) AS left_edge, round((bin + 1) / 30e0, 3) AS right_edge,
   CAST(coalesce(sum(1 - y), 0) AS BIGINT) AS legit, CAST(coalesce(sum(y), 0) AS BIGINT) AS fraud
   FROM edges LEFT JOIN sc ON p >= lo AND p < hi GROUP BY bin)"""


@query("agg_06_score_histogram", rules(HISTOGRAM + " SELECT * FROM hist"))
def _(spark, folder):
    return M.score_histogram(C.scores(spark, folder).where("head = 'combined'"))


@query("agg_07_normalised_histogram", rules(HISTOGRAM + """
 SELECT bin, round((left_edge + right_edge) / 2, 9) AS mid,
   round(legit / greatest((SELECT sum(legit) FROM hist), 1)::DOUBLE * 100, 9) AS legit_pct,
   round(fraud / greatest((SELECT sum(fraud) FROM hist), 1)::DOUBLE * 100, 9) AS fraud_pct
 FROM hist"""))
def _(spark, folder):
    h = M.score_histogram(C.scores(spark, folder).where("head = 'combined'"))
    n = M.normalised_histogram(h)
    return n.select("bin", *[F.round(c, 9).alias(c) for c in ("mid", "legit_pct", "fraud_pct")])


VALUE_SCORES = """WITH vs AS (SELECT 'value' AS head, value AS p,
   CAST(event_type = 'error' AS INTEGER) AS y FROM events)"""
LINE_SCORES = """WITH ls AS (SELECT 'price' AS head, l_extendedprice AS p,
   CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""


@query("agg_08_roc_auc", VALUE_SCORES + CURVE.format(by="head", src="vs")
       + " SELECT head, round(auc, 9) AS auc, n_pos, n_neg FROM met")
def _(spark, folder):
    m = M.ranking_metrics(C.value_scores(spark, folder), ["head"])
    return m.select("head", F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query("agg_08_roc_auc_order_lines", LINE_SCORES + CURVE.format(by="head", src="ls")
       + " SELECT head, round(auc, 9) AS auc, round(ap, 9) AS ap, n_pos, n_neg FROM met")
def _(spark, folder):
    m = M.ranking_metrics(C.line_scores(spark, folder), ["head"])
    return m.select("head", F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"),
                    "n_pos", "n_neg")


@query("agg_09_average_precision", VALUE_SCORES + CURVE.format(by="head", src="vs")
       + " SELECT head, round(ap, 9) AS ap FROM met")
def _(spark, folder):
    m = M.ranking_metrics(C.value_scores(spark, folder), ["head"])
    return m.select("head", F.round("ap", 9).alias("ap"))


@query("agg_10_curves", VALUE_SCORES + CURVE.format(by="head", src="vs") + """
 SELECT head, p, CAST(cp AS BIGINT) AS cum_pos, CAST(cn AS BIGINT) AS cum_neg,
   round(cp::DOUBLE / (cp + cn), 9) AS precision, round(cp::DOUBLE / np, 9) AS recall,
   round(cn::DOUBLE / nn, 9) AS fpr FROM cumul""")
def _(spark, folder):
    c = M.curve(C.value_scores(spark, folder))
    return c.select("head", "p", "cum_pos", "cum_neg",
                    *[F.round(x, 9).alias(x) for x in ("precision", "recall", "fpr")])


@query("agg_11_confusion", rules("""
, c AS (SELECT head, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS BIGINT) AS tp,
   CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS BIGINT) AS fp,
   CAST(count(*) FILTER (p < 0.5 AND y = 1) AS BIGINT) AS fn,
   CAST(count(*) FILTER (p < 0.5 AND y = 0) AS BIGINT) AS tn FROM scores GROUP BY head)
 SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision,
   round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall FROM c"""))
def _(spark, folder):
    c = M.confusion(C.scores(spark, folder))
    return c.withColumns({x: F.round(x, 9) for x in ("precision", "recall")})


@query("agg_12_lift", rules(CURVE.format(by="head", src="scores") + """,
 base AS (SELECT auc AS b_auc, ap AS b_ap FROM met WHERE head = 'raw')
 SELECT head, """ + rnd("(auc - b_auc) / nullif(b_auc, 0) * 100", 2) + """ AS auc_lift_pct,
   """ + rnd("(ap - b_ap) / nullif(b_ap, 0) * 100", 2) + """ AS ap_lift_pct
 FROM met, base WHERE head <> 'raw'"""))
def _(spark, folder):
    m = M.lift(M.ranking_metrics(C.scores(spark, folder), ["head"]))
    return m.where("head <> 'raw'").select("head", "auc_lift_pct", "ap_lift_pct")


SUMMARY = """ SELECT head AS key, CASE head WHEN 'raw' THEN 'Raw tabular features'
   WHEN 'embed' THEN 'Foundation-model embeddings' WHEN 'combined' THEN 'Combined'
   ELSE 'External scorer' END AS label, round(auc, 4) AS test_auc, round(ap, 4) AS test_ap,
   head = 'external' AS stub FROM met"""


@query("agg_13_model_summary", rules(TEST_SCORES
       + CURVE.format(by="head", src="test_scores") + SUMMARY))
def _(spark, folder):
    return M.head_summary(M.ranking_metrics(C.test_scores(spark, folder), ["head"]))


@query("flagship_heads_on_test_split", rules(TEST_SCORES
       + CURVE.format(by="head", src="test_scores") + """
 SELECT head, n_pos, n_neg, round(auc, 6) AS auc, round(ap, 6) AS ap,
   """ + rnd("(auc - b_auc) / nullif(b_auc, 0) * 100", 2) + """ AS auc_lift_pct,
   """ + rnd("(ap - b_ap) / nullif(b_ap, 0) * 100", 2) + """ AS ap_lift_pct
 FROM met, (SELECT auc AS b_auc, ap AS b_ap FROM met WHERE head = 'raw')"""))
def _(spark, folder):
    m = M.ranking_metrics(C.test_scores(spark, folder), ["head"])
    return M.lift(m).withColumns({c: F.round(c, 6) for c in ("auc", "ap")})


@query("agg_14_map_extent", """
WITH pts AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
w AS (SELECT *, coalesce(nullif(x1 - x0, 0), 1) * 0.08e0 AS px,
             coalesce(nullif(y1 - y0, 0), 1) * 0.08e0 AS py FROM b)
SELECT round(x0 - px, 9) AS x_low, round(x1 + px, 9) AS x_high,
       round(y0 - py, 9) AS y_low, round(y1 + py, 9) AS y_high FROM w""")
def _(spark, folder):
    pts = read_table(spark, folder, "embeddings").select(
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))
    e = M.map_extent(pts)
    return e.select(*[F.round(c, 9).alias(c) for c in e.columns])


@query("agg_17_latest_per_group", """
SELECT o_custkey AS "user", max(o_orderkey) FILTER (o_orderdate = m) AS latest_order,
       max(o_orderdate) AS created_at
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders)
GROUP BY o_custkey""")
def _(spark, folder):
    o = read_table(spark, folder, "orders")
    latest = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    return (o.groupBy(F.col("o_custkey").alias("user")).agg(latest.alias("r"))
            .select("user", F.col("r.o_orderkey").alias("latest_order"),
                    F.col("r.o_orderdate").alias("created_at")))


@query("agg_18_latency_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50,
       round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS worst, count(*) AS calls
FROM events GROUP BY event_type""")
def _(spark, folder):
    e = read_table(spark, folder, "events")
    q = exact_quantiles(e, "value", [0.5, 0.95], ["event_type"])
    at = lambda i: F.round(F.max(F.when(F.col("i") == i, F.col("value"))), 9)
    wide = q.groupBy("event_type").agg(at(0).alias("p50"), at(1).alias("p95"))
    calls = e.groupBy(F.col("event_type").alias("_type")).agg(
        F.max("value").alias("worst"), F.count(F.lit(1)).alias("calls"))
    # A null type is a group of its own on both sides.
    return wide.join(calls, F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


@query("agg_20_row_count", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem")
def _(spark, folder):
    return read_table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lineitem").alias("name"), "n")
