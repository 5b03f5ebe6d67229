"""Ordered scans over tables too large for one task.

A running sum, a row number or a "previous row" over a whole table has no
partition key, so a plain window would sort everything in one task. Here the rows
are dealt into ranges of the order key and written once with their range; each
range is then scanned in its own task, and a summary per range carries the state
across the cuts. One key (or group) holding most of the rows is spread over many
ranges. Everything after the write reads the written ranges, so all branches of a
plan see the same cuts and the input is not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark.session import materialize

CELLS = 65536
EDGE_ROWS = 1_000_000  # rows one task may rank
_STEPS = 4


def default_ranges(df: DataFrame) -> int:
    """One range per shuffle partition of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order_by: list[str], ranges: int | None = None) -> DataFrame:
    """Written copy of ``df`` with ``_range``: numbers of the ranges in key order.

    Rows of equal keys share a range; nulls come first, as they do in windows.
    """
    dealt = df.repartitionByRange(ranges or default_ranges(df), *order_by)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of column pairs in which a null equals a null."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def prefix_sum(df: DataFrame, order_by: list[str], sums: dict[str, str],
               group_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Running totals (current row included) in the order of ``order_by``.

    ``sums`` maps output column to input column. (group_by, order_by) must be
    unique per row: group ties first. Null groups are groups.
    """
    group = list(group_by or [])
    d = ranged(df, [*group, *order_by], ranges)
    per_range = d.groupBy(*group, "_range").agg(
        *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    earlier = (W.partitionBy(*group).orderBy("_range")
               .rowsBetween(W.unboundedPreceding, -1))
    # A group has an offset only where it crosses a cut: at most one row per range.
    offsets = per_range.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_at"),
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in sums],
        F.count(F.lit(1)).over(earlier).alias("_before")).where("_before > 0").drop("_before")
    inside = (W.partitionBy(*group, "_range").orderBy(*order_by)
              .rowsBetween(W.unboundedPreceding, 0))
    joined = d.join(F.broadcast(offsets), _same(
        [("_range", "_at"), *[(g, f"_g{i}") for i, g in enumerate(group)]]), "left")
    for out, c in sums.items():
        joined = joined.withColumn(
            out, F.sum(c).over(inside) + F.coalesce(F.col(f"_o_{out}"), F.lit(0)))
    return joined.drop("_range", *offsets.columns)


def dense_ids(df: DataFrame, order_by: list[str], name: str = "pos",
              group_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """0..n-1 in the order of ``order_by`` (per group when given)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (prefix_sum(one, order_by, {name: "_one"}, group_by, ranges)
            .withColumn(name, F.col(name) - 1).drop("_one"))


def previous_value(df: DataFrame, group_by: list[str], order_by: list[str], value: Column,
                   name: str, ranges: int | None = None) -> DataFrame:
    """``value`` of the row before, within its group; NULL on a group's first row.

    Only the first row of a range needs something from outside: the last row of the
    range before, one row per range.
    """
    order = [*group_by, *order_by]
    key = F.struct(*group_by)
    here = F.struct(key.alias("g"), F.col("_v").alias("v"))
    d = ranged(df.withColumn("_v", value), order, ranges)
    last = d.groupBy("_range").agg(F.max_by(here, F.struct(*order)).alias("last"))
    # One entry per range, looked at by the first row of a range only.
    cuts = last.agg(F.sort_array(F.collect_list(F.struct(
        F.col("_range").alias("at"), "last")))).scalar()
    before = F.try_element_at(F.filter("_cuts", lambda c: c["at"] < F.col("_range")), F.lit(-1))
    inside = W.partitionBy("_range").orderBy(*order)
    return (d.withColumn("_lag", F.lag(here).over(inside)).withColumn("_cuts", cuts)
            .withColumn("_b", F.coalesce(F.col("_lag"), before["last"]))
            .withColumn(name, F.when(F.col("_b.g").eqNullSafe(key), F.col("_b.v")))
            .drop("_range", "_cuts", "_lag", "_b", "_v"))


def range_with_position(counts: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """(by, _range, _skip): the range holding position ``wanted`` of each group.

    ``counts``: (by, _range, _n), a few rows per range. ``wanted`` may use ``_all``, the
    group's number of rows; positions count from 0. _skip is how many rows of that
    range lie before it.
    """
    running = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    d = (counts.withColumn("_first", F.coalesce(F.sum("_n").over(running), F.lit(0)))
         .withColumn("_all", F.sum("_n").over(W.partitionBy(*by))).withColumn("_want", wanted))
    inside = (F.col("_want") >= F.col("_first")) & (
        F.col("_want") < F.col("_first") + F.col("_n"))
    return d.where(inside).select(*by, "_range", (F.col("_want") - F.col("_first")).alias("_skip"))


def thin_positions(df: DataFrame, position: str, length: Column, points: int = 100) -> DataFrame:
    """Keep at most ``points`` evenly spaced positions of 0..length-1.

    Position i*(length-1)/(points-1), cut to a whole number, for each i; a row
    stays when it is one of them. Tested per row, so nothing is expanded.
    """
    m = F.least(F.lit(points), length)
    span, gaps = length - 1, m - 1
    pos, step = F.col(position), span / F.nullif(gaps, F.lit(0))
    near = F.round(pos * gaps / F.nullif(span, F.lit(0)))
    hit = pos == span  # the last point is the end itself
    for shift in (-1, 0, 1):  # rounding can move the matching i by one
        i = near + shift
        hit = hit | (i.between(0, gaps - 1) & (F.floor(i * step) == pos))
    return df.where(F.when(gaps < 1, pos == 0).otherwise(hit))


def time_gap(txn: DataFrame, ranges: int | None = None) -> DataFrame:
    """Seconds since the previous transaction of the same card (``time_delta_s``)."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    d = previous_value(txn.withColumn("_ts", micros), ["user", "card"], ["_ts", "row_id"],
                       F.col("_ts"), "_prev", ranges)
    return (d.withColumn("time_delta_s", (F.col("_ts") - F.col("_prev")) / F.lit(1e6))
            .drop("_ts", "_prev"))


def class_stride(df: DataFrame, order_by: list[str], label: str, budget: int) -> DataFrame:
    """All positives, and every k-th negative so that both fit the display budget."""
    n = df.agg(F.struct(F.sum(F.col(label)).alias("pos"),
                        F.sum(1 - F.col(label)).alias("neg"))).scalar()
    room = F.greatest(F.lit(0).cast("bigint"), F.lit(budget) - n["pos"])
    stride = (F.when(n["neg"] <= room, F.lit(1))
              .when(room == 0, n["neg"] + 1)
              .otherwise(F.ceil(n["neg"] / room)))
    ids = dense_ids(df, order_by, "_i", group_by=[label])
    return ids.where((F.col(label) == 1) | (F.col("_i") % stride == 0)).drop("_i")


def rows_at(placed: DataFrame, wanted, cells: int = CELLS,
            edge_rows: int = EDGE_ROWS) -> list:
    """The rows (_s, _u, _k) at one position of each stratum, in the order of (_u, _k).

    ``placed`` is a written table with a stratum ``_s`` (a few classes), a place ``_u`` in
    [0, 1) and a key ``_k``. ``wanted`` maps {stratum: rows} to {stratum: position from 1};
    a position of 0 asks for no row. Only histograms and these rows reach the driver.

    Each step counts the rows per cell of the interval that holds the position and goes on in
    the one cell that it falls in, until no more than ``edge_rows`` are left to rank. Where places
    do not tell the rows apart, what is left is numbered over ranges instead.
    """
    def of_stratum(values: dict) -> Column:
        out = F.lit(None).cast("bigint")
        for stratum, value in values.items():
            out = F.when(F.col("_s").eqNullSafe(F.lit(stratum)), F.lit(value)).otherwise(out)
        return out

    rest, inside, take, largest = F.col("_u"), F.lit(True), None, 0
    upto = W.partitionBy("_s").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(_STEPS):
        cell = F.floor(rest * cells)
        counts = materialize(placed.where(inside).groupBy("_s", cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n")), "histogram")
        if take is None:
            sizes = counts.groupBy("_s").agg(F.sum("_n").alias("n")).collect()
            take = {s: n for s, n in wanted({r["_s"]: r["n"] for r in sizes}).items() if n > 0}
        if not take:
            return []
        edges = (counts.withColumns({"_to": F.sum("_n").over(upto), "_need": of_stratum(take)})
                 .where("_to >= _need AND _to - _n < _need").collect())
        take = {r["_s"]: r["_need"] - r["_to"] + r["_n"] for r in edges}
        inside = inside & (cell == of_stratum({r["_s"]: r["_cell"] for r in edges}))
        largest = max((r["_n"] for r in edges), default=0)
        if largest <= edge_rows:
            break
        rest = rest * cells - cell  # the place within the cell, in the same order
    edge = placed.where(inside)
    if largest <= edge_rows:
        ranked = edge.withColumn("_r", F.row_number().over(
            W.partitionBy("_s").orderBy("_u", "_k")).cast("bigint"))
    else:
        ranked = dense_ids(edge, ["_u", "_k"], "_r", ["_s"]).withColumn("_r", F.col("_r") + 1)
    return ranked.where(F.col("_r") == of_stratum(take)).select("_s", "_u", "_k").collect()


def middle_rows(df: DataFrame, order_by: list[str], label: str) -> DataFrame:
    """The row at position floor(n/2) of each class, nulls first; of rows alike in
    ``order_by`` any one.

    Only the order columns are written. ``rows_at`` finds the rows' keys by histograms of the
    first order column (a whole number; others are numbered over ranges), and the result is a
    filter of ``df`` on these keys.
    """
    thin = materialize(df.select(F.col(label).alias("_s"), F.struct(*order_by).alias("_k")),
                       "order-keys")
    first, place = F.col("_k")[order_by[0]], F.lit(0.0)
    if isinstance(df.schema[order_by[0]].dataType, T.IntegralType):
        box = thin.agg(F.min(first).alias("low"), F.max(first).alias("high")).first()
        if box["low"] is not None and box["low"] < box["high"]:
            share = (first.cast("double") - float(box["low"])) / float(box["high"] - box["low"])
            place = F.when(first.isNull(), 0.0).otherwise(F.lit(0.25) + share / 2)
    found = rows_at(thin.withColumn("_u", place),
                    lambda sizes: {s: n // 2 + 1 for s, n in sizes.items()})
    chosen = F.lit(False)
    for row in found:
        same = F.col(label).eqNullSafe(F.lit(row["_s"]))
        for c in order_by:
            same = same & F.col(c).eqNullSafe(F.lit(row["_k"][c]).cast(df.schema[c].dataType))
        chosen = chosen | same
    return df.where(chosen).dropDuplicates([label])


def row_order_split(df: DataFrame, order_by: list[str], train: float = 0.70,
                    until_val: float = 0.85) -> DataFrame:
    """train / val / test by row order, cut at int(n*train) and int(n*until_val)."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    pos = F.col("pos")
    return dense_ids(df, order_by, "pos").withColumn(
        "split", F.when(pos < F.floor(n * F.lit(train)), "train")
        .when(pos < F.floor(n * F.lit(until_val)), "val").otherwise("test"))
