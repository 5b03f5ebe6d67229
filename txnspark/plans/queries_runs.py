"""Registered run-history queries, on the history derived from daily evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.plans import common as C
from txnspark.plans import runs as R
from txnspark.plans.oracle import rnd, rules
from txnspark.plans.queries_aggregates import CURVE
from txnspark.plans.registry import query
from txnspark.session import new_path
from txnspark.sources import documents

HISTORY = CURVE.format(by="d, head", src="scores") + """,
day AS (SELECT d, count(*) AS n, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS run
  FROM feat GROUP BY d),
runs AS (SELECT d, run, 'r' || run || '-' || d || 'T000000' AS run_id, round(n / 10, 1) AS duration_sec,
  CAST(least(run - 1, 4) AS INTEGER) AS tier, [4000, 8000, 12000, 16000, 20000][least(run, 5)] AS embed_max,
  CAST([0.35, 0.55, 0.75, 0.90, 1.00][least(run, 5)] AS DOUBLE) AS scale FROM day),
models AS (SELECT runs.*, head AS key, round(auc, 4) AS test_auc, round(ap, 4) AS test_ap,
  auc, ap FROM runs JOIN met USING (d)),
reg AS (SELECT run, run_id, coalesce(test_auc >= 0.5, false) AS registered,
  coalesce(test_auc >= 0.5, false) AND coalesce(test_ap >= 0.05, false) AS deployed
  FROM models WHERE key = 'combined')"""


def history_sql(body):
    return rules(HISTORY + "\n" + body)


@query("src_15_run_history", history_sql("""
SELECT run, run_id, embed_max, duration_sec, registered FROM runs JOIN reg USING (run, run_id)"""))
def _(spark, folder):
    path = new_path(spark, "history")
    h = C.history(spark, folder)
    documents.append_runs(h.where("run % 2 = 1"), path)
    documents.append_runs(h.where("run % 2 = 0"), path)
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return documents.run_history(spark, path).orderBy("run").select(
        "run", "run_id", "budget.embed_max", "duration_sec", "registry.registered")


@query("jsn_02_nested_fields", history_sql("""
SELECT run_id, embed_max, registered, key, test_ap FROM models JOIN reg USING (run, run_id)"""))
def _(spark, folder):
    return R.models_long(C.history(spark, folder), "budget.embed_max",
                         "registry.registered").select(
        "run_id", "embed_max", "registered", "key", "test_ap")


@query("jsn_03_models_by_key", history_sql("""
SELECT run, max(test_auc) FILTER (key = 'combined') AS combined_auc,
  max(test_ap) FILTER (key = 'raw') AS raw_ap, CAST(count(*) AS INTEGER) AS heads
FROM models GROUP BY run"""))
def _(spark, folder):
    by_key = F.map_from_entries(F.transform("models", lambda m: F.struct(m["key"], m)))
    return C.history(spark, folder).select("run", by_key.alias("m")).select(
        "run", F.col("m")["combined"]["test_auc"].alias("combined_auc"),
        F.col("m")["raw"]["test_ap"].alias("raw_ap"), F.size("m").alias("heads"))


@query("fil_04_registered_runs", history_sql("SELECT run, run_id FROM reg WHERE registered"))
def _(spark, folder):
    return C.history(spark, folder).where("registry.registered").select("run", "run_id")


@query("joi_05_patch_registry", history_sql("""
SELECT run, registered OR run % 3 = 0 AS registered,
  CASE WHEN run % 3 = 0 THEN run * 10 WHEN registered THEN run END AS model_version, deployed
FROM reg"""))
def _(spark, folder):
    h = C.history(spark, folder)
    patches = h.where("run % 3 = 0").select(
        "run_id", F.lit(True).alias("registered"), (F.col("run") * 10).alias("model_version"))
    unknown = h.where("run = 1").select(
        F.lit("r99-nope").alias("run_id"), F.lit(True).alias("registered"),
        F.lit(7).alias("model_version"))
    return R.patch_registry(h, patches.unionByName(unknown)).select(
        "run", "registry.registered", "registry.model_version", "registry.deployed")


@query("agg_15_heads_present", history_sql("SELECT DISTINCT key FROM models"))
def _(spark, folder):
    return R.models_long(C.history(spark, folder)).select("key").distinct()


@query("agg_16_metric_pivot", history_sql("""
SELECT run, max(test_ap) FILTER (key = 'raw') AS raw, max(test_ap) FILTER (key = 'embed') AS embed,
  max(test_ap) FILTER (key = 'combined') AS combined, max(test_ap) FILTER (key = 'external') AS external
FROM models GROUP BY run"""))
def _(spark, folder):
    return R.metric_pivot(C.history(spark, folder), "test_ap")


ORDER_CURVE = """WITH c AS (SELECT o_orderpriority AS model, o_orderdate,
   round(avg(o_totalprice) / 500000, 9) AS auc FROM orders GROUP BY ALL),
curve AS (SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY o_orderdate) AS INTEGER)
   AS round, auc FROM c)"""


@query("win_06_best_round", ORDER_CURVE + """
SELECT model, min(round) FILTER (auc = m) AS best_round, max(m) AS best_auc
FROM (SELECT *, max(auc) OVER (PARTITION BY model) AS m FROM curve) GROUP BY model""")
def _(spark, folder):
    return R.best_round(C.rounds_curve(spark, folder), ["model"])


@query("win_07_early_stop", ORDER_CURVE + """,
s AS (SELECT *, max(auc) OVER (PARTITION BY model ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING
   AND 1 PRECEDING) AS before FROM curve),
l AS (SELECT *, max(CASE WHEN before IS NULL OR auc > before THEN round END)
   OVER (PARTITION BY model ORDER BY round) AS last FROM s),
t AS (SELECT model, coalesce(min(round) FILTER (round - last >= 20), max(round)) AS stop_round
   FROM l GROUP BY model)
SELECT model, stop_round, last AS best_round FROM l JOIN t USING (model) WHERE round = stop_round""")
def _(spark, folder):
    return R.early_stop(C.rounds_curve(spark, folder), ["model"])


@query("win_10_next_run", history_sql("""
SELECT CAST(max(run) + 1 AS INTEGER) AS run, CAST(least(max(run), 4) AS INTEGER) AS tier,
  [4000, 8000, 12000, 16000, 20000][least(max(run) + 1, 5)] AS embed_max FROM runs"""))
def _(spark, folder):
    h = C.history(spark, folder)
    nxt = h.agg((F.max("run") + 1).alias("run"))
    return nxt.select("run", R.budget(F.col("run")).alias("b")).select(
        "run", "b.tier", "b.embed_max")


@query("win_11_budget_never_shrinks", history_sql("""
SELECT CAST(0 AS BIGINT) AS shrinks, count(*) FILTER (run > 5 AND embed_max <> 20000) AS off_plateau,
  count(*) AS runs FROM runs"""))
def _(spark, folder):
    return R.budget_violations(C.history(spark, folder))


@query("win_14_metric_change", history_sql("""
SELECT run, key, test_ap, """ + rnd(
    "test_ap - lag(test_ap) OVER (PARTITION BY key ORDER BY run)", 9) + """ AS change FROM models"""))
def _(spark, folder):
    return R.metric_change(C.history(spark, folder), "test_ap").withColumn(
        "change", F.round("change", 9))


@query("srt_04_newest_version", history_sql("""
SELECT run, CASE WHEN registered THEN run ELSE 0 END AS version FROM reg ORDER BY version DESC"""))
def _(spark, folder):
    return C.history(spark, folder).select(
        "run", F.coalesce("registry.model_version", F.lit(0)).alias("version")).orderBy(
        F.desc("version"))


@query("srt_05_newest_run_first", history_sql("SELECT run, run_id FROM runs ORDER BY run DESC"))
def _(spark, folder):
    return C.history(spark, folder).select("run", "run_id").orderBy(F.desc("run"))


@query("srt_08_last_run", history_sql("SELECT run, run_id FROM runs ORDER BY run DESC LIMIT 1"))
def _(spark, folder):
    return C.history(spark, folder).select("run", "run_id").orderBy(F.desc("run")).limit(1)


@query("mlx_08_scaled_rounds", history_sql("""
SELECT run, CAST(greatest(60, round_even(400 * scale, 0)) AS INTEGER) AS raw,
  CAST(greatest(60, round_even(435 * scale, 0)) AS INTEGER) AS embed,
  CAST(greatest(60, round_even(512 * scale, 0)) AS INTEGER) AS combined FROM runs"""))
def _(spark, folder):
    return C.history(spark, folder).select("run", "budget.n_estimators.*")


@query("mlx_09_budget_ladder", history_sql("""
SELECT run, tier, least(embed_max, 6000) AS embed_max, scale FROM runs"""))
def _(spark, folder):
    h = C.history(spark, folder).select("run", R.budget(F.col("run"), ceiling=6000).alias("b"))
    return h.select("run", "b.tier", "b.embed_max", "b.scale")


@query("mlx_19_run_records", history_sql("""
, raw AS (SELECT run, auc AS a0, ap AS p0 FROM models WHERE key = 'raw')
SELECT run, run_id, tier, embed_max, duration_sec, registered,
  max(""" + rnd("(auc - a0) / nullif(a0, 0) * 100", 2) + """) FILTER (key = 'combined') AS combined_auc_pct,
  max(""" + rnd("(ap - p0) / nullif(p0, 0) * 100", 2) + """) FILTER (key = 'embed') AS embed_ap_pct,
  count(*) AS heads
FROM models JOIN raw USING (run) JOIN reg USING (run, run_id) GROUP BY ALL"""))
def _(spark, folder):
    return C.history(spark, folder).select(
        "run", "run_id", "budget.tier", "budget.embed_max", "duration_sec", "registry.registered",
        "lift.combined_auc_pct", "lift.embed_ap_pct",
        F.size("models").cast("bigint").alias("heads"))


@query("mlx_20_cost_quality", history_sql("""
SELECT run, run_id, CAST(d AS VARCHAR) AS finished_at, embed_max AS rows,
  CAST(greatest(60, round_even(512 * scale, 0)) AS INTEGER) AS rounds, duration_sec,
  registered, test_auc, test_ap FROM models JOIN reg USING (run, run_id) WHERE key = 'combined'"""))
def _(spark, folder):
    return R.cost_quality(C.history(spark, folder))
