"""Registered streams: the given events, landed in chunks, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.functions.features import with_basic_features
from txnspark.functions.rules import fallback_heads, fallback_score
from txnspark.plans import common as C
from txnspark.plans import training as T
from txnspark.plans.oracle import events, rules
from txnspark.plans.queries_models import SPLIT_SQL, _saved
from txnspark.plans.registry import query
from txnspark.session import new_path
from txnspark.sources.transactions import from_events, read_table
from txnspark.streaming import jobs, key_index, keyed


def _folders(spark, name, *parts):
    root = new_path(spark, name)
    return [f"{root}/{p}" for p in parts]


def _event_stream(spark, folder):
    schema = read_table(spark, folder, "events").schema
    return from_events(jobs.read_stream(spark, folder, schema, files="events.parquet"))


@query("str_01_score_stream", rules("""SELECT row_id, round(base, 9) AS base,
  round(greatest(least(base + 0.08e0, 0.99), 0.01), 9) AS combined FROM rule"""))
def _(spark, folder):
    out, checkpoint = _folders(spark, "score-stream", "out", "checkpoint")

    def score(rows):
        f = with_basic_features(rows)
        base = fallback_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
        return f.select("row_id", F.round(base, 9).alias("base"),
                        F.round(fallback_heads(base)["combined"], 9).alias("combined"))

    jobs.score_stream(_event_stream(spark, folder), score, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("str_01_bundle_stream", events("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed "
                                      "FROM feat"))
def _(spark, folder):
    # The saved bundle on a stream and on the table give the same probabilities.
    bundle = T.Bundle.load(spark, _saved(spark, folder))
    out, checkpoint = _folders(spark, "bundle-stream", "out", "checkpoint")
    score = lambda rows: bundle.score(with_basic_features(rows))
    jobs.score_stream(_event_stream(spark, folder), score, out, checkpoint).awaitTermination()
    live = spark.read.parquet(out).select("row_id", F.col("p_combined").alias("live"))
    table = bundle.score(C.features(spark, folder)).select("row_id", "p_combined")
    return table.join(live, "row_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(F.col("live") - F.col("p_combined")) > 1e-12).alias("changed"))


@query("str_02_time_gap_stream", events("""
SELECT row_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER
   (PARTITION BY "user", card ORDER BY ts, row_id)) / 1e6 AS time_delta_s FROM txn"""))
def _(spark, folder):
    landing, out, state, checkpoint = _folders(
        spark, "gap-stream", "landing", "out", "state", "checkpoint")
    rows = C.split_features(spark, folder).select("row_id", "user", "card", "ts", "split")
    # Three chunks, the newest first; the stream stops and resumes between them.
    for split in ("test", "train", "val"):
        chunk = rows.where(F.col("split") == split).drop("split")
        chunk.write.mode("append").parquet(landing)
        stream = jobs.read_stream(spark, landing, chunk.schema)
        jobs.gap_stream(stream, out, state, checkpoint).awaitTermination()
    return jobs.landed_gaps(spark, out, chunk.schema).select("row_id", "time_delta_s")


@query("str_02_keyed_time_gap", events("""
SELECT row_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER
   (PARTITION BY "user", card ORDER BY ts, row_id)) / 1e6 AS time_delta_s FROM txn"""))
def _(spark, folder):
    # The newest chunk first: most later rows are older than the window a card's state keeps.
    landing, out, checkpoint = _folders(spark, "keyed-gaps", "landing", "out", "checkpoint")
    rows = C.split_features(spark, folder).select("row_id", "user", "card", "ts", "split")
    for split in ("test", "train", "val"):
        chunk = rows.where(F.col("split") == split).drop("split")
        chunk.write.mode("append").parquet(landing)
        stream = jobs.read_stream(spark, landing, chunk.schema)
        keyed.keyed_gap_stream(stream, out, checkpoint, delay_s=86_400).awaitTermination()
    return keyed.keyed_gaps(spark, out).select("row_id", "time_delta_s")


@query("str_03_exactly_once_landing", events(SPLIT_SQL + """
 SELECT split, count(*) AS rows, CAST(sum(row_id) AS BIGINT) AS ids FROM split_rows
 GROUP BY split"""))
def _(spark, folder):
    landing, out, checkpoint = _folders(spark, "land-stream", "landing", "out", "checkpoint")
    rows = C.split_features(spark, folder).select("row_id", "split")
    for split in ("train", "val", "test"):
        chunk = rows.where(F.col("split") == split)
        chunk.write.mode("append").parquet(landing)
        stream = jobs.read_stream(spark, landing, chunk.schema)
        jobs.land_stream(stream, out, checkpoint).awaitTermination()
        jobs.write_batch(chunk, out, ("train", "val", "test").index(split))  # a replay
    return spark.read.parquet(out).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


@query("str_04_deduplicated_stream", events('SELECT row_id, "user", amount FROM txn'))
def _(spark, folder):
    landing, out, checkpoint = _folders(spark, "dedupe-stream", "landing", "out", "checkpoint")
    txn = C.load_transactions(spark, folder).select("row_id", "user", "amount", "ts")
    # The newest half lands first, then everything: late rows never seen, and repeats.
    middle = txn.agg(F.expr("max(ts) - (max(ts) - min(ts)) / 2")).scalar()
    for chunk in (txn.where(F.col("ts") > middle), txn, txn.where(F.col("row_id") % 3 == 0)):
        chunk.write.mode("append").parquet(landing)
        stream = jobs.read_stream(spark, landing, txn.schema)
        jobs.land_unique(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("row_id", "user", "amount")


@query("str_04_indexed_deduplication", events('SELECT row_id, "user", amount FROM txn'))
def _(spark, folder):
    landing, out, index, checkpoint = _folders(
        spark, "indexed-dedupe", "landing", "out", "index", "checkpoint")
    txn = C.load_transactions(spark, folder).select("row_id", "user", "amount", "ts")
    middle = txn.agg(F.expr("max(ts) - (max(ts) - min(ts)) / 2")).scalar()
    for chunk in (txn.where(F.col("ts") > middle), txn, txn.where(F.col("row_id") % 3 == 0)):
        chunk.write.mode("append").parquet(landing)
        stream = jobs.read_stream(spark, landing, txn.schema)
        key_index.land_unique_indexed(stream, out, index, checkpoint, buckets=8).awaitTermination()
    return spark.read.parquet(out).select("row_id", "user", "amount")
