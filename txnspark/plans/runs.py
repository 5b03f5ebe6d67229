"""Training budgets, run records and run-over-run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.operators.heads import early_stop  # noqa: F401 (part of the run rules)
from txnspark.operators.metrics import head_summary, lift

# --- fixed values: budget ladder, ceilings and boosting rounds per head ---
TIER_ROWS = [4000, 8000, 12000, 16000, 20000]
TIER_SCALE = [0.35, 0.55, 0.75, 0.90, 1.00]
ROWS_CEILING = 20000
FULL_ROUNDS = {"raw": 400, "embed": 435, "combined": 512}
MIN_ROUNDS = 60
# --- end of fixed values ---


def tier_of(run) -> Column:
    """0-based tier of a 1-based run; the last tier repeats."""
    return F.least(run - 1, F.lit(len(TIER_ROWS) - 1)).cast("int")


def tier_rows(tier, ceiling: int = ROWS_CEILING) -> Column:
    return F.least(F.get(F.array(*map(F.lit, TIER_ROWS)), tier), F.lit(ceiling))


def tier_scale(tier) -> Column:
    return F.get(F.array(*map(F.lit, TIER_SCALE)), tier)


def scaled_rounds(full: int, scale) -> Column:
    """Boosting rounds under a budget, halves to even, never below the floor."""
    return F.greatest(F.lit(MIN_ROUNDS), F.bround(F.lit(float(full)) * scale, 0).cast("int"))


def budget(run, ceiling: int = ROWS_CEILING) -> Column:
    tier = tier_of(run)
    rounds = [scaled_rounds(n, tier_scale(tier)).alias(h) for h, n in FULL_ROUNDS.items()]
    return F.struct(tier.alias("tier"), tier_rows(tier, ceiling).alias("embed_max"),
                    tier_scale(tier).alias("scale"), F.struct(*rounds).alias("n_estimators"))


def empty_registry() -> Column:
    return F.struct(
        F.lit(False).alias("registered"), F.lit(None).cast("int").alias("model_version"),
        F.lit(None).cast("string").alias("version_id"),
        F.lit(None).cast("string").alias("registered_at"), F.lit(False).alias("deployed"),
        F.lit(None).cast("string").alias("deployed_at"))


def records(metrics: DataFrame, days: DataFrame) -> DataFrame:
    """Run records from metrics per (d, head); one run per day, numbered by date.

    ``days`` has one row per calendar date, so its window is small.
    """
    summary = head_summary(metrics.select("d", "head", "auc", "ap"), keep=["d"])
    models = summary.groupBy("d").agg(F.array_sort(F.collect_list(
        F.struct("key", "label", "test_auc", "test_ap", "stub"))).alias("models"))
    up = lift(metrics.select("d", "head", "auc", "ap"), group_by=("d",))
    pick = lambda h, c: F.max(F.when(F.col("head") == h, F.col(f"{c}_lift_pct")))
    lifts = up.groupBy("d").agg(F.struct(*[
        pick(h, c).alias(f"{h}_{c}_pct") for h in ("embed", "combined") for c in ("auc", "ap")
    ]).alias("lift"))
    numbered = days.withColumn("run", F.row_number().over(W.orderBy("d")).cast("int"))
    stamp = F.col("d").cast("string")
    combined = F.filter("models", lambda m: m["key"] == "combined")[0]
    good = F.coalesce(combined["test_auc"] >= 0.5, F.lit(False))
    live = good & F.coalesce(combined["test_ap"] >= 0.05, F.lit(False))
    registry = F.struct(
        good.alias("registered"), F.when(good, F.col("run")).alias("model_version"),
        F.when(good, F.concat(F.lit("v"), stamp)).alias("version_id"),
        F.when(good, stamp).alias("registered_at"), live.alias("deployed"),
        F.when(live, stamp).alias("deployed_at"))
    return (numbered.join(models, "d").join(lifts, "d").select(
        "run", F.concat(F.lit("r"), F.col("run").cast("string"), F.lit("-"), stamp,
                        F.lit("T000000")).alias("run_id"),
        stamp.alias("started_at"), stamp.alias("finished_at"),
        F.round(F.col("rows") / 10, 1).alias("duration_sec"),
        budget(F.col("run")).alias("budget"), "models", "lift",
        F.lit(True).alias("external"), registry.alias("registry")))


def append_index(history: DataFrame) -> Column:
    """The next run number, as a constant of the history."""
    return history.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).scalar()


def patch_registry(history: DataFrame, patches: DataFrame) -> DataFrame:
    """Merge (run_id, registry fields) into the matching runs; an unknown id changes nothing."""
    fields = history.schema["registry"].dataType.fieldNames()
    given = [f for f in fields if f in patches.columns]
    renamed = patches.select("run_id", *[F.col(f).alias(f"_p_{f}") for f in given])
    merged = F.struct(*[
        (F.coalesce(F.col(f"_p_{f}"), F.col(f"registry.{f}")) if f in given
         else F.col(f"registry.{f}")).alias(f) for f in fields])
    return (history.join(renamed, "run_id", "left").withColumn("registry", merged)
            .drop(*[f"_p_{f}" for f in given]))


def models_long(history: DataFrame, *extra) -> DataFrame:
    return history.select("run", "run_id", *extra, F.inline("models"))


def metric_pivot(history: DataFrame, metric: str) -> DataFrame:
    """One row per run, one column per head."""
    return models_long(history).groupBy("run").pivot("key", S.HEADS).agg(F.first(metric))


def metric_change(history: DataFrame, metric: str) -> DataFrame:
    """Change of a metric against the run before, per head."""
    runs = W.partitionBy("key").orderBy("run")
    return models_long(history).select(
        "run", "key", metric, (F.col(metric) - F.lag(metric).over(runs)).alias("change"))


def cost_quality(history: DataFrame, head: str = "combined") -> DataFrame:
    """Rows, rounds and duration beside the quality they bought."""
    flat = history.select(
        "run", "run_id", "finished_at", F.col("budget.embed_max").alias("rows"),
        F.col("budget.n_estimators")[head].alias("rounds"), "duration_sec",
        F.col("registry.registered").alias("registered"), F.inline("models"))
    return flat.where(F.col("key") == head).select(
        "run", "run_id", "finished_at", "rows", "rounds", "duration_sec", "registered",
        "test_auc", "test_ap")


def budget_violations(history: DataFrame) -> DataFrame:
    """Runs granted less than the run before: none, if the ladder holds."""
    runs = W.orderBy("run")
    steps = history.select("run", F.col("budget.embed_max").alias("rows"),
                           F.col("budget.scale").alias("scale"))
    shrinks = ((F.col("rows") < F.lag("rows").over(runs))
               | (F.col("scale") < F.lag("scale").over(runs)))
    plateau = (F.col("run") > len(TIER_ROWS)) & (F.col("rows") != max(TIER_ROWS))
    return steps.select(shrinks.alias("s"), plateau.alias("p")).agg(
        F.count_if("s").alias("shrinks"), F.count_if("p").alias("off_plateau"),
        F.count(F.lit(1)).alias("runs"))


def best_round(curve: DataFrame, by: list[str]) -> DataFrame:
    """The first round with the best value; rounds are 1-based."""
    return curve.groupBy(*by).agg(
        F.max_by("round", F.struct("auc", -F.col("round"))).alias("best_round"),
        F.max("auc").alias("best_auc"))
