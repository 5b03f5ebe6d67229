"""Time gaps with state per card: a batch costs its own rows and its cards' state.

Each card keeps its rows of the last ``delay_s`` seconds and the newest one before them, in
RocksDB. A row that arrives out of order inside that window is placed among them, and the landed
row it now precedes is landed again. A row older than the window cannot be placed from the
state; it goes to the side output, and so does a card's first row, which may not be the first
where state expired. ``keyed_gaps`` merges the side output: the few cards it touches are
computed again from their landed rows, all others are read as they are.

The rows of one card and batch pass through one task. ``jobs.gap_stream`` scans ranges instead
and suits tables in which a card holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from txnspark.operators.ordered import previous_value
from txnspark.streaming.jobs import write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACED, REVISED, LATE, FIRST = 0, 1, 2, 3
_NO_TIME = -(1 << 62)  # stands for a null time, which comes first

_STATE = T.StructType([
    T.StructField("floor_ts", T.LongType()), T.StructField("floor_id", T.LongType()),
    T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType()))])
_OUT = "row_id long, user {user}, card {card}, micros long, time_delta_s double, status int"


def place(new_ts: np.ndarray, new_ids: np.ndarray, state: tuple | None, delay_us: int
          ) -> tuple[dict[str, np.ndarray], tuple]:
    """(rows to land, next state) of one card.

    ``state``: (floor_ts, floor_id, times, ids), the floor None where nothing lies before.
    Rows to land have ts, ids, prev (``_NO_TIME``: none) and status.
    """
    floor_ts, floor_id, ts, ids = state or (None, None, [], [])
    late = np.zeros(len(new_ts), dtype=bool)
    if floor_ts is not None:
        late = (new_ts < floor_ts) | ((new_ts == floor_ts) & (new_ids < floor_id))
    all_ts = np.concatenate([np.asarray(ts, np.int64), new_ts[~late]])
    all_ids = np.concatenate([np.asarray(ids, np.int64), new_ids[~late]])
    new = np.arange(len(all_ts)) >= len(ts)
    order = np.lexsort((all_ids, all_ts))
    all_ts, all_ids, new = all_ts[order], all_ids[order], new[order]
    before = _NO_TIME if floor_ts is None else floor_ts
    prev = np.concatenate([[before], all_ts[:-1]]).astype(np.int64)[:len(all_ts)]
    status = np.where(new, PLACED, REVISED)
    if len(all_ts) and floor_ts is None:
        status[0] = FIRST
    follows_new = np.concatenate([[False], new[:-1]])[:len(all_ts)]
    shown = new | follows_new
    out = {"ts": np.concatenate([all_ts[shown], new_ts[late]]),
           "ids": np.concatenate([all_ids[shown], new_ids[late]]),
           "prev": np.concatenate([prev[shown], np.full(int(late.sum()), _NO_TIME)]),
           "status": np.concatenate([status[shown], np.full(int(late.sum()), LATE)])}
    if len(all_ts):
        kept = int(np.searchsorted(all_ts, all_ts[-1] - delay_us))
        if kept:
            floor_ts, floor_id = int(all_ts[kept - 1]), int(all_ids[kept - 1])
        all_ts, all_ids = all_ts[kept:], all_ids[kept:]
    return out, (floor_ts, floor_id, all_ts.tolist(), all_ids.tolist())


class CardGaps(StatefulProcessor):
    """Gaps of one card's rows, in whatever order they come."""

    def __init__(self, delay_us: int, idle_ms: int | None):
        self.delay_us, self.idle_ms = delay_us, idle_ms

    def init(self, handle) -> None:
        self.recent = handle.getValueState("recent", _STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Plain rows: most cards have a few in a batch, and a frame for each costs more than they do.
        given = [(_NO_TIME if r.micros is None else r.micros, r.row_id) for r in rows]
        ts, ids = np.array(given, dtype=np.int64).reshape(-1, 2).T
        state = self.recent.get()
        out, after = place(ts, ids, tuple(state) if state else None, self.delay_us)
        self.recent.update(after)
        for row_id, at, prev, status in zip(*[out[c].tolist() for c in (
                "ids", "ts", "prev", "status")]):
            known = prev != _NO_TIME and at != _NO_TIME
            yield Row(row_id=row_id, user=key[0], card=key[1], micros=at,
                      time_delta_s=(at - prev) / 1e6 if known else None, status=status)

    def close(self) -> None:
        pass


def keyed_gap_stream(stream: DataFrame, path: str, checkpoint: str, delay_s: int,
                     idle_s: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Lands (row_id, user, card, micros, time_delta_s, status) of every row of the stream.

    ``idle_s`` lets the state of a card without rows for so long expire. A replayed batch finds
    the state before it and rewrites its own partition.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    kind = lambda c: stream.schema[c].dataType.simpleString()
    rows = stream.select("user", "card", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
                         F.col("row_id").cast("long").alias("row_id"))
    gaps = rows.groupBy("user", "card").transformWithState(
        statefulProcessor=CardGaps(delay_s * 1_000_000, idle_s and idle_s * 1000),
        outputStructType=_OUT.format(user=kind("user"), card=kind("card")),
        outputMode="Update", timeMode="ProcessingTime" if idle_s else "None")
    writer = gaps.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
    writer = writer.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keyed_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, user, card, time_delta_s) of all landed rows, the side output merged."""
    rows = spark.read.parquet(path)
    fields = ["user", "card", "micros", "time_delta_s", "status"]
    newest = rows.groupBy("row_id").agg(F.max(F.struct("batch_id", *fields)).alias("_r")).select(
        "row_id", *[F.col("_r")[f].alias(f) for f in fields])
    touched = rows.groupBy(F.col("user").alias("_u"), F.col("card").alias("_c")).agg(
        F.count_if(F.col("status") == LATE).alias("late"),
        F.count_distinct(F.when(F.col("status") == FIRST, F.col("row_id"))).alias("firsts"))
    touched = touched.where((F.col("late") > 0) | (F.col("firsts") > 1)).select("_u", "_c")
    same = F.col("user").eqNullSafe(F.col("_u")) & F.col("card").eqNullSafe(F.col("_c"))
    time = F.when(F.col("micros") != _NO_TIME, F.col("micros"))
    again = previous_value(newest.join(touched, same, "left_semi").withColumn("micros", time),
                           ["user", "card"], ["micros", "row_id"], F.col("micros"), "_prev")
    again = again.withColumn("time_delta_s", (F.col("micros") - F.col("_prev")) / F.lit(1e6))
    kept = ["row_id", "user", "card", "time_delta_s"]
    return newest.join(touched, same, "left_anti").select(*kept).union(again.select(*kept))
