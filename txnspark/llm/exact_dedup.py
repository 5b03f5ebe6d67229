"""Exact de-duplication through an extendible-hash index on shared files.

DataFrame functions only. One scan hashes every normalised text. Equal texts
collapse to index entries (bytes compared by grouping on the text itself, after a
partial aggregation in the scan tasks, so a hot text leaves each task as one row).
The entries are written as an index: a directory over the leading hash bits points
to buckets, a bucket too full is split by one more bit, and where all directory
bits in use run out the directory doubles. Each owner task holds a range of
buckets, that is a range of hashes, and chains entries whose hash is equal though
their text is not. Rows find their entry by hash and SHA-256; which row stays is known
from the grouping before the index is written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import SPACES, fresh, row_key, text_of, without
from txnspark.session import materialize

BUCKET_ENTRIES = 100_000
MAX_DEPTH = 62


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; a null text is empty."""
    return F.regexp_replace(text_of(text), f"{SPACES}+", " ")


def _prefix(hash_: Column, depth) -> Column:
    """The leading ``depth`` bits of a 64-bit hash as a number (depth 1 to 62)."""
    return F.call_function("shiftrightunsigned", hash_, F.lit(64) - depth)


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """(depth, bucket): the buckets of the index, each holding ``capacity`` hashes or fewer.

    Starts with about one bucket per ``capacity`` hashes and splits each bucket that
    is too full by its next bit, doubling the directory when the bucket used all its
    bits, until none is too full or the bits run out. Counts distinct hashes: entries
    of one hash can't be split and are chained instead. The driver sees two numbers
    per round.
    """
    hashes = materialize(entries.select("hash").distinct(), "hashes")
    total = hashes.count()
    depth = max(1, min(MAX_DEPTH, math.ceil(math.log2(max(2, total / capacity)))))
    open_ = hashes.withColumn("depth", F.lit(depth))
    done = None
    while True:
        at = F.col("depth")
        buckets = materialize(
            open_.groupBy("depth", _prefix(F.col("hash"), at).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")), "directory")
        fits = buckets.where((F.col("n") <= capacity) | (F.col("depth") >= MAX_DEPTH))
        done = fits if done is None else done.union(fits)
        over = buckets.where((F.col("n") > capacity) & (F.col("depth") < MAX_DEPTH))
        if over.isEmpty():
            return done.select("depth", "bucket")
        full = over.select("depth", "bucket")
        open_ = (open_.withColumn("bucket", _prefix(F.col("hash"), at))
                 .join(full, ["depth", "bucket"], "left_semi")
                 .select("hash", (at + 1).alias("depth")))


def build_index(docs: DataFrame, text: str = "text",
                capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(keys, index), both on shared files.

    keys: (doc_id, row_key, hash, text_sha256), one row per row of ``docs``.
    index: (bucket, depth, hash, chain, text_sha256, keep_id, keep_key, group_size), one
    entry per different text.
    """
    rows = docs.select("doc_id", row_key(docs).alias("row_key"),
                       normalised(text).alias("_text"))
    rows = rows.withColumn("hash", F.xxhash64("_text"))
    keys = materialize(rows.select("doc_id", "row_key", "hash",
                                   F.sha2("_text", 256).alias("text_sha256")), "dedup-keys")
    # Fixed-width aggregates keep this a hash aggregation with a partial step. A null
    # doc_id is left for last: it stays only where the whole group has none.
    entries = materialize(
        rows.groupBy("hash", "_text").agg(
            F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "dedup-entries")
    buckets = materialize(directory(entries, capacity), "dedup-directory")
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # at most 62
    # A hash lies in the one bucket whose bits it starts with.
    candidates = F.explode(F.array(*[F.struct(
        F.lit(d).alias("depth"), _prefix(F.col("hash"), F.lit(d)).alias("bucket"))
        for d in sorted(depths)] or [F.struct(F.lit(1).alias("depth"), F.lit(0).cast("long")
                                              .alias("bucket"))]))
    placed = (entries.withColumn("_at", candidates)
              .select("*", "_at.depth", "_at.bucket").drop("_at")
              .join(buckets, ["depth", "bucket"], "left_semi"))
    chain = W.partitionBy("depth", "bucket", "hash").orderBy("keep_id", "text_sha256")
    index = materialize(placed.withColumn("chain", F.row_number().over(chain)), "dedup-index")
    return keys, index


def exact_duplicates(docs: DataFrame, text: str = "text",
                     capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space, tab and the controls 10 to
    13 became one space. Of equal texts the row with the smallest doc_id stays.
    group_size counts rows. Rows that repeat doc_id and text share the verdict of their
    doc_id (see ``drop_exact_duplicates`` for keeping just one). A null text is empty,
    a null doc_id is kept only if all doc_ids of its group are null. An empty table
    gives an empty result.
    """
    keys, index = build_index(docs, text, capacity)
    found = index.select(F.col("hash").alias("_hash"), F.col("text_sha256").alias("_sha"),
                         "keep_id", "group_size")
    # The probe: equal hash, then along the chain to the entry of this text.
    return (keys.join(found, (F.col("hash") == F.col("_hash"))
                      & (F.col("text_sha256") == F.col("_sha")))
            .select("doc_id", "row_key", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each different text."""
    found = materialize(exact_duplicates(docs), "dedup-found")
    gone = found.where(~F.col("kept")).select("doc_id", "row_key")
    # Several rows can share the doc_id that stays (repeated rows, null doc_ids).
    tied = materialize(found.where("kept").groupBy("doc_id", "text_sha256").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_key").alias("row_key")).where("n > 1"), "ties")
    if tied.isEmpty():
        return without(docs, materialize(gone, "dropped"))
    same = tied.select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s"),
                       F.col("row_key").alias("_k"))
    loses = found.where("kept").join(
        same, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_s")))
    rest = without(docs, materialize(
        gone.union(loses.where("row_key <> _k").select("doc_id", "row_key")), "dropped"))
    # What is left of a tie are rows alike in every column.
    winners = materialize(tied.select("doc_id", "row_key"), "winners")
    one_each = without(rest, winners)
    mark, number = fresh(docs, "_key"), fresh(docs, "_number")
    rows = rest.join(
        winners.select(F.col("doc_id").alias(number), F.col("row_key").alias(mark)),
        row_key(docs).eqNullSafe(F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(number)))
    # Alike in every column, so any of them; each scan task sends one at most.
    row = fresh(docs, "_row")
    repeated = rows.groupBy(mark, number).agg(F.first(F.struct(
        *[F.col(f"`{c}`") for c in docs.columns])).alias(row)).select(f"{row}.*")
    return one_each.union(repeated)
