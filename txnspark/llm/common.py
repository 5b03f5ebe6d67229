"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of every word rule in this package: space and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, f"{SPACES}+"), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, wherever ``use`` repeats it."""
    return F.get(F.transform(F.array(value), use), 0)


def row_key(df: DataFrame) -> Column:
    """64-bit hash over all columns: tells rows apart that share a doc_id."""
    column = lambda c, kind: (F.col(f"`{c}`").cast("string")
                              if "map<" in kind else F.col(f"`{c}`"))
    return F.xxhash64(*[column(c, kind) for c, kind in df.dtypes])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


BITMAP = 1 << 15  # bits of one bitmap, fixed by Spark's bitmap functions
BITS_PER_KEY, MAX_BITMAPS = 16, 1 << 10  # 4 MB at most


def may_be_among(keys: DataFrame, name: str):
    """A test of 64-bit hashes: true for all in the column ``name`` of ``keys``, a written table,
    and for few others.

    Thins rows before a join that would shuffle them whole. The bits of one hash per key are at
    most 4 MB however many keys there are; more keys let more others through.
    """
    bits = BITMAP
    while bits < min(BITS_PER_KEY * keys.count(), MAX_BITMAPS * BITMAP):
        bits *= 2
    at = lambda key: F.pmod(key, F.lit(bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(at(F.col(name))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at(F.col(name)))).alias("bits"))
    found = maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))).scalar()

    def test(key: Column) -> Column:
        bit = F.bitmap_bit_position(at(key)).cast("int")
        byte = F.substring(found[F.bitmap_bucket_number(at(key))], F.shiftright(bit, 3) + 1,
                           F.lit(1))
        return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit % 8) == 1,
                          F.lit(False))
    return test


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows listed in ``dropped`` (doc_id, row_key).

    ``dropped`` is a written table, so Spark knows its size and sends it to all
    executors only when it is below the broadcast threshold. Beyond, only rows that
    may be listed are shuffled; ``docs`` is read twice for that.
    """
    mark, number = fresh(docs, "_gone"), fresh(docs, "_gone_id")
    listed = may_be_among(dropped, "row_key")(row_key(docs))
    gone = dropped.select(F.col("doc_id").alias(number), F.col("row_key").alias(mark))
    return docs.where(~listed).union(docs.where(listed).join(
        gone, row_key(docs).eqNullSafe(F.col(mark))
        & F.col("doc_id").eqNullSafe(F.col(number)), "left_anti"))


def one_of_alike(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one of the rows alike in every column that ``repeated``, a written table
    of (doc_id, row_key), names; all other rows stay. Each scan task sends one at most."""
    mark, number, row = fresh(docs, "_key"), fresh(docs, "_number"), fresh(docs, "_row")
    rows = docs.join(
        repeated.select(F.col("doc_id").alias(number), F.col("row_key").alias(mark)),
        row_key(docs).eqNullSafe(F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(number)))
    one = rows.groupBy(mark, number).agg(F.first(F.struct(
        *[F.col(f"`{c}`") for c in docs.columns])).alias(row)).select(f"{row}.*")
    return without(docs, repeated).union(one)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker process, over its tasks."""
    name = "_txnspark_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
