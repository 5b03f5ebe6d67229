"""Transaction tables derived from the given event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.functions.hashing import uniform


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """The canonical transaction columns, one row per event, plus ``ts``."""
    k = F.get_json_object("props", "$.k").cast("int")
    online = F.col("event_type").isin("click", "error")
    chance = (F.lit(0.003)
              + F.lit(0.02) * (F.col("event_type") == "error").cast("double")
              + F.lit(0.05) * (F.col("value") >= 150).cast("double")
              + F.lit(0.01) * F.hour("ts").between(1, 4).cast("double"))
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("user"),
        (F.col("event_id") % 5).alias("card"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)").cast("string")).alias("amount"),
        F.when(online, "Online Transaction")
        .when(F.col("event_type") == "view", "Swipe Transaction")
        .otherwise("Chip Transaction").alias("use_chip"),
        (k.cast("bigint") * 7919 - 400000).alias("merchant_name"),
        F.when(online, "ONLINE")
        .otherwise(F.concat(F.lit("CITY_"), (k % 7).cast("string"))).alias("merchant_city"),
        F.when(~online, F.concat(F.lit("S"), (k % 5).cast("string"))).alias("merchant_state"),
        F.when(~online, F.lit(10000.0) + k * 37).alias("zip"),
        (F.lit(5000) + (k % 20) * 10).cast("int").alias("mcc"),
        F.when(uniform("event_id", "label") < chance, "Yes").otherwise("No").alias("is_fraud"),
        "ts",
    )


def load_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(read_table(spark, folder, "events"))


def order_dates(orders: DataFrame) -> DataFrame:
    """(row_id, d) of the order table, the longer calendar of the two."""
    d = (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100
         + F.dayofmonth("o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("row_id"), d.alias("d"))
