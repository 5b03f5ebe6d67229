"""Registered ordered computations: cut-offs, prefix sums, ids, gaps, early stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.operators import metrics as M
from txnspark.operators import ordered as O
from txnspark.operators.splits import split_plan
from txnspark.plans import common as C
from txnspark.plans.oracle import events, rules
from txnspark.plans.queries_aggregates import CURVE, VALUE_SCORES
from txnspark.plans.registry import query
from txnspark.sources.transactions import order_dates, read_table


@query("win_01_temporal_cutoffs", """
WITH o AS (SELECT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100
             + day(o_orderdate) AS INTEGER) AS d FROM orders),
c AS (SELECT d, count(*) AS n FROM o GROUP BY d),
r AS (SELECT d, sum(n) OVER (ORDER BY d) AS cum, sum(n) OVER () AS total FROM c)
SELECT min(CASE WHEN cum >= 0.8e0 * total THEN d END) AS train_cut,
       min(CASE WHEN cum >= 0.9e0 * total THEN d END) AS test_cut FROM r""")
def _(spark, folder):
    return split_plan(order_dates(read_table(spark, folder, "orders"))).select(
        "train_cut", "test_cut")


@query("win_02_prefix_sum", """
SELECT p, CAST(sum(n) OVER (ORDER BY p) AS BIGINT) AS cum_n FROM
 (SELECT l_extendedprice AS p, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    keys = lines.groupBy(F.col("l_extendedprice").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return O.prefix_sum(keys, ["p"], {"cum_n": "n"}).select("p", "cum_n")


@query("win_03_dense_row_ids", """
SELECT event_id AS row_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events""")
def _(spark, folder):
    e = read_table(spark, folder, "events")
    return O.dense_ids(e, ["ts", "event_id"]).select(F.col("event_id").alias("row_id"), "pos")


@query("win_04_thinned_curve", VALUE_SCORES + CURVE.format(by="head", src="vs") + """,
idx AS (SELECT head, p, row_number() OVER (PARTITION BY head ORDER BY p DESC) - 1 AS pos,
   round(cp::DOUBLE / (cp + cn), 9) AS precision, round(cp::DOUBLE / np, 9) AS recall FROM cumul),
n AS (SELECT head, count(*) AS len, least(100, count(*)) AS m FROM idx GROUP BY head),
want AS (SELECT DISTINCT head, CASE WHEN range = m - 1 THEN len - 1
    ELSE CAST(floor(range * ((len - 1) / (m - 1)::DOUBLE)) AS BIGINT) END AS pos
  FROM n, range(100) WHERE range < m)
SELECT idx.* FROM idx JOIN want USING (head, pos)""")
def _(spark, folder):
    c = M.thinned_curve(C.value_scores(spark, folder))
    return c.select("head", "p", "pos", F.round("precision", 9).alias("precision"),
                    F.round("recall", 9).alias("recall"))


@query("win_05_time_gap", events("""
SELECT row_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER
   (PARTITION BY "user", card ORDER BY ts, row_id)) / 1e6 AS time_delta_s FROM txn"""))
def _(spark, folder):
    return O.time_gap(C.load_transactions(spark, folder)).select("row_id", "time_delta_s")


@query("win_09_stride_sample", rules("""
, pts AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS i FROM feat),
n AS (SELECT count(*) FILTER (y = 0) AS neg, greatest(0, 1500 - count(*) FILTER (y = 1)) AS room
      FROM feat),
s AS (SELECT CASE WHEN neg <= room THEN 1 WHEN room = 0 THEN neg + 1
      ELSE CAST(ceil(neg / room::DOUBLE) AS BIGINT) END AS stride FROM n)
SELECT row_id, y FROM pts, s WHERE y = 1 OR i % stride = 0"""))
def _(spark, folder):
    f = C.features(spark, folder).select("row_id", "y")
    return O.class_stride(f, ["row_id"], "y", budget=1500)


@query("win_12_middle_rows", events("""
, r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS i,
   count(*) OVER (PARTITION BY y) AS n FROM feat)
SELECT row_id, y FROM r WHERE i = n // 2"""))
def _(spark, folder):
    return O.middle_rows(C.features(spark, folder).select("row_id", "y"), ["row_id"], "y")


@query("win_13_row_order_split", events("""
, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n
  FROM feat)
SELECT row_id, pos, CASE WHEN pos < floor(n * 0.70e0) THEN 'train'
  WHEN pos < floor(n * 0.85e0) THEN 'val' ELSE 'test' END AS split FROM r"""))
def _(spark, folder):
    return O.row_order_split(C.features(spark, folder).select("row_id"), ["row_id"])
