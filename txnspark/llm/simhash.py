"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from txnspark.llm.common import (let, may_be_among, one_of_alike, row_key, text_of, without,
                                 words_of)
from txnspark.llm.components import connected_components
from txnspark.session import materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
_BLOCK = 1 << 15  # shingles counted at once, bounds memory for very long texts
# The corpus stage: five-word shingles, Jaccard similarity of 4/5 or more.
STAGE_SHINGLE = 5
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 28, 5
_TILE = 1 << 11  # shingles times hashes at once
_XOR, _ODD = (np.array([[xxhash.xxh64_intdigest(f"{name}{i}", SEED) | odd]
                        for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)
              for name, odd in (("xor", 0), ("odd", 1)))


def _words(text: str) -> list[bytes]:
    # bytes.lower and bytes.split know ASCII only: A-Z, space and the controls 9 to 13.
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingle_blocks(words: list[bytes], shingle: int):
    """Hashes of all word shingles, ``_BLOCK`` at a time."""
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:len(ends) - size]] if words else []
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        yield np.array(
            [digest(joined[s:e - 1], SEED) for s, e in
             zip(starts[at:at + _BLOCK], ends[at + size - 1:at + size - 1 + _BLOCK])],
            dtype=np.uint64)


def _majority(blocks) -> int:
    ones, count = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        count += len(hashes)
    major = np.packbits(ones * 2 > count, bitorder="little")
    return int(major.view(np.int64)[0])


def _fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return _majority(_shingle_blocks(_words(text), shingle))


@pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over lower-cased word shingles, as a signed number."""
    return pd.Series([_fingerprint(t or "") for t in texts], dtype="int64")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _half(fp: Column, which: int) -> Column:
    return (fp if which == 0 else F.shiftrightunsigned(fp, 32)).bitwiseAND(F.lit(0xFFFFFFFF))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints ``fp`` at Hamming distance 3 or less.

    Multi-index hashing with two 32-bit segments. Two fingerprints at distance 3
    agree in one segment up to one bit, so the ball of radius 1 around a segment
    is probed in the table of that segment. Of two segments one bit apart, only the
    one that has the bit set needs to probe (with the bit cleared); the other is
    found by it. Each fingerprint makes about 34 probes however large the table is.
    The complete distance is verified inside the join, and a pair that both
    segments could find is left to the low one, so no pair comes twice.
    """
    fps = prints.select("fp")
    tables, probes = [], []
    for which in (0, 1):
        half = _half(F.col("fp"), which)
        cleared = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(31)),
                     lambda i: F.getbit(half, i) == 1),
            lambda i: half - F.call_function("shiftleft", F.lit(1).cast("long"), i))
        ball = F.concat(F.array(half), cleared)
        tables.append(fps.select(F.lit(which).alias("segment"), half.alias("key"),
                                 F.col("fp").alias("b")))
        probes.append(fps.select(F.lit(which).alias("p_segment"), F.explode(ball).alias("p_key"),
                                 F.col("fp").alias("a")))
    table, probe = tables[0].union(tables[1]), probes[0].union(probes[1])
    a, b = F.col("a"), F.col("b")
    low, high = _distance(_half(a, 0), _half(b, 0)), _distance(_half(a, 1), _half(b, 1))
    found_once = F.when(
        F.col("segment") == 0, (low > 0) | (a < b)
    ).otherwise((low > 1) & ((high > 0) | (a < b)))
    # Spark sizes the probes as one row each, so it might take them for small and broadcast them.
    return (probe.hint("merge").join(table, (F.col("p_segment") == F.col("segment"))
                                     & (F.col("p_key") == F.col("key"))
                                     & (_distance(a, b) <= DISTANCE) & (a != b) & found_once)
            .select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, row_key, fp, component_id, keeper).

    component_id is the smallest doc_id among all rows whose fingerprints are
    linked, directly or over others; keeper is (doc_id, row_key) of the row to keep.
    Rows with equal fingerprints become one node before any link is searched, so
    copies cost one row each, and a group's size never shows in the link search.

    Null text counts as empty; texts without a word share fingerprint zero. A null
    doc_id never becomes a component_id unless the whole component has none. An
    empty table gives an empty result. Other columns only enter row_key.
    """
    rows = materialize(
        docs.select("doc_id", row_key(docs).alias("row_key"),
                    fingerprint(text_of(text)).alias("fp")), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(_order()).alias("first")), "nodes")
    return _labelled(rows, nodes, materialize(fingerprint_links(nodes), "fp-links"))


def _order() -> Column:
    # Nulls sort first in a struct, so rows without doc_id are put last.
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")


def _labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with keeper and component_id, from links (a, b) between nodes ``fp``."""
    linked = materialize(
        connected_components(links)
        .join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first"), "linked")
    firsts = linked.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("keeper"))
    labels = linked.join(firsts, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "keeper")
    every = materialize(
        nodes.join(labels, F.col("fp") == F.col("_fp"), "left")
        .select(F.col("fp").alias("_fp"), F.coalesce("keeper", "first").alias("keeper")),
        "labels")
    return (rows.join(every, F.col("fp") == F.col("_fp")).drop("_fp")
            .withColumn("component_id", F.col("keeper.doc_id")))


@pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()),
                          T.StructField("keys", T.ArrayType(T.LongType()))]))
def _signature(texts: pd.Series) -> pd.DataFrame:
    """Hash of the words, SimHash, and bucket keys (MinHash bands and the SimHash)."""
    out = []
    for text in texts:
        words = _words(text or "")
        blocks = list(_shingle_blocks(words, STAGE_SHINGLE))
        sim, keys = _majority(blocks), []
        if words:
            least = np.full(len(_XOR), np.iinfo(np.uint64).max, dtype=np.uint64)
            for hashes in blocks:
                for at in range(0, len(hashes), _TILE):
                    mixed = (hashes[None, at:at + _TILE] ^ _XOR) * _ODD
                    np.minimum(least, mixed.min(axis=1), out=least)
            keys = [_signed(xxhash.xxh64_intdigest(part.tobytes(), band))
                    for band, part in enumerate(least.reshape(BANDS, BAND_ROWS))] + [sim]
        out.append((_signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)), sim, keys))
    return pd.DataFrame(out, columns=["fp", "sim", "keys"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shingle_set(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = words_of(F.translate(text, upper, upper.lower()))
    size = lambda w: F.least(F.lit(STAGE_SHINGLE), F.size(w))
    return let(words, lambda w: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(w) - size(w) + 1),
        lambda i: F.xxhash64(F.slice(w, i, size(w))))))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more."""
    side = lambda n: sets.select(F.col("fp").alias(n), F.col("set").alias(f"_{n}"))
    both = F.size(F.array_intersect("_a", "_b"))
    # The side that may be one node for many pairs is joined while the rows are thin.
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .withColumn("_both", both)
            .where(F.col("_both") * SIMILAR[1]
                   >= (F.size("_a") + F.size("_b") - F.col("_both")) * SIMILAR[0])
            .select("a", "b"))


def _unsettled_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of ``nodes`` (fp, root) with different roots: all that can have a
    Jaccard similarity of 0.8 or more.

    Prefix filter: with the shingles of every node in one order, rarest first, two such nodes
    share one among the first fifth of both. A passage that many texts share is frequent and
    so comes last; it makes candidates only where it is four fifths of a text. Sizes and the
    places of the shared shingle bound the overlap inside the join. Shingles of one node only
    can't be shared and take part as a number.
    """
    num, den = SIMILAR
    items = nodes.join(sets, "fp").select("fp", "root", F.size("set").alias("size"),
                                          F.explode("set").alias("shingle"))
    often = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = (items.join(often, "shingle").groupBy("fp", "root", "size")
               .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("tail"))
               .withColumn("alone", F.col("size") - F.size("tail")))
    head = F.col("size") - F.ceil(F.col("size") * num / den) + 1 - F.col("alone")
    posts = materialize(
        ordered.select("fp", "root", "size", "alone", F.posexplode(F.slice(
            "tail.shingle", F.lit(1), F.greatest(head, F.lit(0)).cast("int")))
            .alias("at", "shingle"))
        .select("fp", "root", "size", "shingle",
                (F.col("size") - F.col("alone") - F.col("at")).alias("rest")), "prefixes")
    x, y = posts.alias("x"), posts.alias("y")
    both = F.least("x.rest", "y.rest")  # the shared shingle and all that follow it
    return (x.join(y, (F.col("x.shingle") == F.col("y.shingle"))
                   & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
                   & (both * (num + den) >= (F.col("x.size") + F.col("y.size")) * num))
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct())


def similar_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """As ``near_duplicates``, where linked means a five-word Jaccard similarity of 0.8 or more.

    A 64-bit SimHash cannot be searched for that: such pairs lie about 10 bits apart and up to
    17, and a ball that wide meets a fixed share of all pairs. So the pairs SimHash finds
    within 3 bits are joined by those that share one of ``BANDS`` MinHash keys of ``BAND_ROWS``
    values (a pair at 0.8 exactly is missed in about 1 of 70,000 cases, one at 0.85 in 1 of 13
    million), and every pair is verified on the shingles.

    In each bucket all nodes are first compared with its most central one, the node whose
    buckets hold the most nodes, which joins a large group at linear cost: the original of many
    copies shares more keys with each of them than they do with each other. Nodes of a bucket
    that are still in different components then go through ``_unsettled_pairs``, which emits
    no bucket's pairs but those that can reach the similarity, and leaves none of these out.

    Null text counts as empty; texts without a word are one node. Rows alike in every column
    get equal results, an empty table an empty one. Texts are read whole, however long. Texts
    are taken as equal when the 64-bit hashes of their words are.
    """
    rows = materialize(
        docs.select("doc_id", row_key(docs).alias("row_key"), _signature(text_of(text)).alias("_s"))
        .select("doc_id", "row_key", "_s.*"), "signatures")
    nodes = materialize(rows.groupBy("fp").agg(
        F.min(_order()).alias("first"), F.first("sim").alias("sim"),
        F.first("keys").alias("keys")), "nodes")
    # Written, because Spark sizes an exploded table as if every node had one key.
    spread = materialize(nodes.select(F.explode("keys").alias("key"), "fp"), "spread-keys")
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(spread.join(shared, "key"), "buckets")
    weight = buckets.groupBy("fp").agg(F.sum("n").alias("weight"))
    centre = (buckets.join(weight, "fp").groupBy("key")
              .agg(F.max(F.struct("weight", "fp"))["fp"].alias("centre")))
    sims = nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("least"))
    near = fingerprint_links(sims)
    ends = lambda n: sims.select(F.col("fp").alias(n), F.col("least").alias(f"_{n}"))
    near = near.join(ends("a"), "a").join(ends("b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    star = buckets.join(centre, "key").where("fp <> centre").select(
        F.col("fp").alias("a"), F.col("centre").alias("b"))
    pairs = materialize(star.union(near).distinct(), "near-candidates")
    wanted = materialize(
        nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp",
                   "left_semi").select("fp", F.col("first.doc_id").alias("_id"),
                                       F.col("first.row_key").alias("_key")), "wanted")
    # Few texts are wanted, and the others are left out before the shuffle.
    texts = docs.where(may_be_among(wanted, "_key")(row_key(docs))).select(
        "doc_id", row_key(docs).alias("row_key"), text_of(text).alias("_text"))
    sets = materialize(
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))
                   & (F.col("row_key") == F.col("_key")))
        .select("fp", _shingle_set(F.col("_text")).alias("set")).dropDuplicates(["fp"]),
        "shingle-sets")
    links = materialize(_similar(pairs, sets), "near-links")
    roots = materialize(connected_components(links).withColumnRenamed("node", "fp"), "near-roots")
    members = buckets.join(roots, "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root"))
    apart = (members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
             .where("r0 <> r1").select("key"))
    unsettled = materialize(
        members.join(apart, "key", "left_semi").select("fp", "root").distinct(), "unsettled")
    crossed = materialize(_unsettled_pairs(unsettled, sets), "cross-candidates")
    links = links.union(materialize(_similar(crossed, sets), "cross-links"))
    return _labelled(rows.select("doc_id", "row_key", "fp"), nodes.select("fp", "first"), links)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the least doc_id."""
    return _one_of_each(docs, near_duplicates(docs))


def drop_similar_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``similar_documents``."""
    return _one_of_each(docs, similar_documents(docs))


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The keepers' rows. Of rows alike in every column one stays."""
    same = (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))
            & (F.col("row_key") == F.col("keeper.row_key")))
    judged = materialize(found.select("doc_id", "row_key", same.alias("stays")), "near-judged")
    kept = without(docs, materialize(
        judged.where(~F.col("stays")).select("doc_id", "row_key"), "dropped"))
    repeated = materialize(judged.where("stays").groupBy("doc_id", "row_key").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    return kept if repeated.isEmpty() else one_of_alike(kept, repeated)
