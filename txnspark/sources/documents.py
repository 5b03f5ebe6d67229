"""JSON in and out: run history, artifacts, scoring requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark.session import path_exists

RUN_SCHEMA = """
  run int, run_id string, started_at string, finished_at string, duration_sec double,
  budget struct<tier:int, embed_max:int, scale:double,
                n_estimators:struct<raw:int, embed:int, combined:int>>,
  models array<struct<key:string, label:string, test_auc:double, test_ap:double, stub:boolean>>,
  lift struct<embed_auc_pct:double, embed_ap_pct:double,
              combined_auc_pct:double, combined_ap_pct:double>,
  external boolean,
  registry struct<registered:boolean, model_version:int, version_id:string,
                  registered_at:string, deployed:boolean, deployed_at:string>,
  diagnostics struct<
    separation:array<struct<bin:int, legit:bigint, fraud:bigint>>,
    importance:array<struct<name:string, importance:double, kind:string>>,
    curves:map<string, struct<rounds:array<int>, auc:array<double>, best_round:int>>>
"""
_CORRUPT = "_corrupt_record"


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records; one JSON document per line."""
    runs.write.mode("append").json(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """All readable records. A missing folder is an empty history, a broken line is skipped."""
    schema = T.StructType.fromDDL(f"{RUN_SCHEMA}, {_CORRUPT} string")
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(RUN_SCHEMA))
    records = (spark.read.schema(schema).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _CORRUPT).json(path))
    # A document without a run number is not a record either.
    return (records.where(F.col(_CORRUPT).isNull() & F.col("run").isNotNull()).drop(_CORRUPT))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def request_rows(requests: DataFrame, body: str, row_schema: str) -> DataFrame:
    """One output row per element of ``{"rows": [...]}``."""
    parsed = F.from_json(F.col(body), f"struct<rows:array<struct<{row_schema}>>>")
    keep = [c for c in requests.columns if c != body]
    return requests.select(*keep, F.inline(parsed["rows"]))


def score_reply(mode: str, tokens: Column, dim: int | Column, scores: dict[str, Column],
                x: Column, y: Column) -> Column:
    """The nested reply for one scored transaction, as JSON text."""
    return F.to_json(F.struct(
        F.lit(mode).alias("mode"), tokens.alias("tokens"), (dim if isinstance(dim, Column) else F.lit(dim)).alias("embedding_dim"),
        F.struct(*[p.alias(k) for k, p in scores.items()]).alias("scores"),
        F.struct(x.alias("x"), y.alias("y")).alias("position")))
