"""Physical plans: nothing row-level may pass through one task."""

import re

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

import __spark_entry__ as entry
from txnspark.operators import ordered as O
from txnspark.operators import sampling as P
from txnspark.operators.vectors import embedding_column, HashedProjection
from txnspark.plans import common as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """The plan without its scalar subqueries (each yields one small row)."""
    return re.split(r"\nSubqueries|\n===== Subqueries", plan(df))[0]


@pytest.mark.parametrize("name", [
    "win_05_time_gap", "src_05_parquet_sink", "fil_01_split_predicates", "tok_05_token_array",
    "smp_01_bernoulli", "rul_01_fallback_score"])
def test_no_single_partition_exchange(spark, name):
    lines = main_plan(entry.queries()[name](spark, FOLDER)).splitlines()
    assert not [x for x in lines if "SinglePartition" in x and "Subquery" not in x
                and x.strip().startswith(("+- Exchange SinglePartition", "Exchange Single"))]


def test_time_gap_shuffles_rows_once(spark):
    gap = main_plan(O.time_gap(C.load_transactions(spark, FOLDER)))
    # Apart from the summary of one row per range, which is aggregated before it moves.
    moved = re.findall(r"Exchange hashpartitioning\(_range[^\n]*\n([^\n]*)", gap)
    assert len([below for below in moved if "partial_max_by" not in below]) == 1
    assert "Join" not in gap


def test_split_and_sample_is_a_narrow_pass(spark):
    from txnspark.plans.ingest import split_and_sample
    p = main_plan(split_and_sample(C.load_transactions(spark, FOLDER), 100, 10).select("row_id"))
    head = p[:p.index("FileScan")] if "FileScan" in p else p
    assert "Exchange hashpartitioning" not in head.split("Subquery")[0]


def test_scan_reads_only_needed_columns(spark):
    p = plan(C.load_transactions(spark, FOLDER).select("row_id", "user"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", p).group(1)
    assert schema == "event_id:bigint,user_id:bigint"


def test_filter_reaches_the_scan(spark):
    df = C.load_transactions(spark, FOLDER).where(F.col("row_id") < 10).select("row_id")
    assert "LessThan(event_id,10)" in plan(df)


def test_exact_sample_never_sorts_the_table(spark):
    p = main_plan(P.exact_sample(C.load_transactions(spark, FOLDER), 50, "s"))
    assert "TakeOrdered" not in p and "rangepartitioning" not in p


def test_embedding_column_needs_no_join(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.array(F.lit(2), F.lit(3)).alias("ids"))
    p = plan(df.withColumn("e", embedding_column(HashedProjection(5, 4), F.col("ids"))))
    assert "Exchange" not in p and "ArrowEvalPython" in p
