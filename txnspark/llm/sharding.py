"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

DataFrame functions only. Rows lie in blocks (by a hash of the row, so the result does
not depend on the file layout). A matrix with exact row sums (block sizes) and column
sums (shard sizes) is drawn from the distribution a uniform shuffle would give it: a
binary tree over the blocks, where each node deals its shard counts to its two halves by
hypergeometric draws. A block permutes its rows and cuts them by its matrix row; the rows
are exchanged; each shard permutes what it got.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import let, row_key, text_of
from txnspark.session import materialize

BLOCK_ROWS = 20_000
SPREAD = 12.0  # standard deviations covered by a draw; beyond lies less than 1e-30


def _uniform(*parts) -> Column:
    """A number in (0, 1) from the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls are marked, if ``marked`` of ``total`` are; ``u`` in (0, 1).

    Inversion by the ratio of neighbouring probabilities, so nothing but products is
    needed. Exact up to double rounding; steps are a few dozen standard deviations.
    """
    def bounds(g: Column) -> Column:
        n, k, d = (g[c].cast("double") for c in ("n", "k", "d"))
        some = F.greatest(n, F.lit(1.0))
        mean = d * k / some
        spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / some) * (n - d)
                                   / F.greatest(n - 1, F.lit(1.0))))
        return let(F.struct(mean.alias("mean"), (spread * SPREAD + SPREAD).alias("reach")),
                   lambda m: F.struct(
                       F.greatest(F.lit(0).cast("long"), g["d"] - (g["n"] - g["k"]),
                                  F.floor(m["mean"] - m["reach"])).alias("start"),
                       F.least(g["k"], g["d"], F.ceil(m["mean"] + m["reach"])).alias("stop")))

    def draw(g: Column) -> Column:
        n, k, d = (g[c].cast("double") for c in ("n", "k", "d"))

        def after(a: Column, x: Column) -> Column:
            """Weight of x + 1 from the weight of x, and the sum so far."""
            y = x.cast("double")
            ratio = (k - y) * (d - y) / ((y + 1) * (n - k - d + y + 1))
            return let(a["w"] * ratio, lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))

        first = F.struct(F.lit(1e-250).alias("w"), F.lit(1e-250).alias("sum"))

        def pick(b: Column) -> Column:
            steps = F.when(b["stop"] > b["start"], F.sequence(b["start"], b["stop"] - 1)).otherwise(
                F.array().cast("array<bigint>"))
            total_weight = F.aggregate(steps, first, after)["sum"]
            return let(F.struct(steps.alias("steps"), (g["u"] * total_weight).alias("goal")),
                       lambda s: F.aggregate(
                           s["steps"], F.struct(first.alias("a"), b["start"].alias("at")),
                           lambda t, x: F.struct(
                               after(t["a"], x).alias("a"),
                               F.when(t["a"]["sum"] < s["goal"], x + 1).otherwise(t["at"])
                               .alias("at")))["at"])
        return let(bounds(g), pick)

    return let(F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d"), u.alias("u")), draw)


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(block, counts): how many rows of each block go to each shard, exactly.

    ``sizes``: (block, n) with blocks 0, 1, 2, ... of a power of two; missing blocks are
    empty. Shard sizes differ by one row at most. One narrow step per level of the tree;
    the sizes of all nodes come from one aggregation.
    """
    spark = sizes.sparkSession
    row = sizes.agg(F.sum("n").alias("n"), F.max("block").alias("last")).first()
    total, levels = row["n"] or 0, max(0, math.ceil(math.log2((row["last"] or 0) + 1)))
    # How many rows the left half of each tree node has.
    at = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))) if levels else F.lit(0)
    node = F.call_function("shiftright", F.col("block"), F.lit(levels) - F.col("level"))
    left = F.call_function("shiftright", F.col("block"),
                           F.lit(levels) - F.col("level") - 1) % 2 == 0
    nodes = materialize(
        sizes.withColumn("level", at).groupBy("level", node.cast("long").alias("node"))
        .agg(F.sum(F.when(left, F.col("n")).otherwise(0)).alias("left")), "tree")
    shares = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    matrix = materialize(spark.range(1).select(
        F.col("id").alias("node"),
        F.array(*[F.lit(s).cast("long") for s in shares]).alias("counts")), "matrix")
    for level in range(levels):
        here = nodes.where(F.col("level") == level).select(F.col("node").alias("_n"), "left")
        both = matrix.join(here, F.col("node") == F.col("_n"), "left").withColumn(
            "left", F.coalesce("left", F.lit(0).cast("long")))
        both = both.withColumn("all", F.aggregate(
            "counts", F.lit(0).cast("long"), lambda a, x: a + x))
        dealt = F.aggregate(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            F.struct(F.col("all").alias("total"), F.col("left").alias("drawn"),
                     F.array().cast("array<bigint>").alias("got")),
            lambda a, s: _deal(a, s, F.get(F.col("counts"), s),
                               _uniform(F.lit(seed), F.lit(level), F.col("node"), s)))
        both = both.withColumn("got", dealt["got"])
        rest = F.zip_with("counts", "got", lambda c, g: c - g)
        matrix = materialize(both.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("counts")))).alias("c"))
            .select("c.node", "c.counts"), "matrix")
    return matrix.select(F.col("node").alias("block"), "counts")


def _deal(state: Column, shard: Column, marked: Column, u: Column) -> Column:
    return let(_hypergeometric(state["total"], marked, state["drawn"], u), lambda got: F.struct(
        (state["total"] - marked).alias("total"), (state["drawn"] - got).alias("drawn"),
        F.concat(state["got"], F.array(got)).alias("got")))


def uniform_shards(docs: DataFrame, shards: int = 8, seed: int = 1,
                   block_rows: int = BLOCK_ROWS, text: str = "text") -> DataFrame:
    """Every row with its shard and its slot there (0, 1, 2, ... without a gap).

    Law ``rows``: shard sizes differ by one row at most, and each way to deal the rows is
    equally likely over seeds. The same rows get the same places under any file layout.
    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: no bytes),
    text_crc32, law, shard, slot, grown_shard (null: this law has no stable growth).

    Rows alike in every column may swap places with each other. Other columns only enter
    the hash. An empty table gives an empty result.
    """
    body = text_of(text)
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"),
                       row_key(docs).alias("_key"))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    blocks = 1 << max(0, math.ceil(math.log2(max(1, total / block_rows))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(blocks)))
    matrix = communication_matrix(
        rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    # Permute the block, then cut it by the running sums of its matrix row.
    local = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key", "doc_id")
    place = rows.withColumn("_place", F.row_number().over(local))
    ends = F.aggregate(
        "counts", F.array().cast("array<bigint>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    cuts = matrix.select(F.col("block").alias("_block"), ends.alias("_ends"))
    dealt = place.join(cuts, F.col("block") == F.col("_block")).withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e < F.col("_place"))))
    # Permute within the shard: the leading bits of a fresh hash pick one of many parts of
    # even size, so a shard is never one task; a part starts where the ones before end.
    parts = F.lit(blocks)
    draw = F.xxhash64(F.lit(seed + 2), "_key")
    dealt = materialize(
        dealt.withColumn("_draw", draw)
        .withColumn("part", F.floor(F.shiftrightunsigned("_draw", 11).cast("double")
                                    / float(1 << 53) * parts).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "part", "_draw", "_key"), "dealt")
    sizes = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "part").orderBy("_draw", "_key", "doc_id")
    return (dealt.withColumn("_at", F.row_number().over(inside))
            .join(starts, (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part")))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_start") + F.col("_at") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
