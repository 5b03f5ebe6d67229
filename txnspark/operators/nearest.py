"""Nearest rows by cosine through inverted lists over centres, re-ranked exactly.

Equal vectors are one entry. Every entry lies in the list of its nearest centre; a query looks
into the lists of its ``probes`` nearest centres. Near lists are put together to blocks of a
bounded number of entries, and blocks of queries meet the blocks that hold lists they look into:
a vector is sent once for each such block, not once for each list, so that vectors without any
clusters, where most lists must be read, cost a plain blocked comparison and no more. How many
lists must be read for the wanted recall is measured: for a bounded set of queries, scored against
all entries, the place of each true neighbour's list in the query's order tells how far one has
to look.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.session import materialize

MIN_BLOCK, MAX_BLOCK = 2048, 32_768  # entries a block
BLOCKS = 8  # wanted at least, where entries suffice
QUERY_CHUNK, MEMBER_CHUNK = 1024, 4096  # scores held at once
MAX_CENTRES = 65_536
SAMPLE_PER_CENTRE = 32
ROUNDS = 2
TUNING_QUERIES = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _vector_type(vectors: DataFrame, vector: str) -> str:
    """Single precision stays as it is given, half as long; scores are in double precision."""
    given = vectors.schema[vector].dataType.simpleString()
    return given if given == "array<float>" else "array<double>"


def entries_of(vectors: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(entries, rows, dimension): different usable vectors with their first k + 1 ids, and the
    entry of each row. Null, empty, zero and non-finite vectors have no direction and are left out."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    v = F.col(vector)
    usable = v.isNotNull() & F.col(key).isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, bad)
    rows = vectors.where(usable).select(F.col(key).alias("id"), v.cast(_vector_type(vectors, vector)).alias("v"))
    first = rows.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return rows, rows, 0
    rows = rows.where(F.size("v") == first["n"])
    named = materialize(rows.groupBy("v").agg(F.min("id").alias("entry")), "entries")
    in_entry = materialize(rows.join(named, "v").select("id", "entry"), "entry-rows")
    few = in_entry.withColumn("_n", F.row_number().over(W.partitionBy("entry").orderBy("id"))).where(
        F.col("_n") <= k + 1).groupBy("entry").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = named.join(few.withColumnRenamed("entry", "_e"), F.col("entry") == F.col("_e")).drop("_e")
    return materialize(entries, "entry-ids"), in_entry, first["n"]


def _cells(centres: np.ndarray, probes: int, groups: np.ndarray | None = None):
    """The ``probes`` nearest centres of each entry, nearest first; with ``groups``, the group of
    the nearest one and then the other groups of all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // len(centres))
        for batch in batches:
            x, found = unit(_dense(batch.column(1), centres.shape[1])), []
            for i in range(0, len(x), step):
                near = x[i:i + step] @ centres.T
                top = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                cells = np.take_along_axis(top, order, 1)
                found.extend(cells if groups is None else map(_in_order, groups[cells]))
            offsets = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))],
                names=["entry", "v", "cells"])
    return run


def _in_order(numbers: np.ndarray) -> np.ndarray:
    """Different numbers in the order of their first place."""
    return numbers[np.sort(np.unique(numbers, return_index=True)[1])]


def _with_cells(entries: DataFrame, centres: np.ndarray, probes: int,
                groups: np.ndarray | None = None) -> DataFrame:
    kinds = [entries.schema[c].dataType.simpleString() for c in ("entry", "v")]
    return entries.select("entry", "v").mapInArrow(
        _cells(centres, min(probes, len(centres)), groups),
        f"entry {kinds[0]}, v {kinds[1]}, cells array<int>")


def fit_centres(entries: DataFrame, dim: int, rows: int, rounds: int = ROUNDS) -> np.ndarray:
    """About a root of the entries as unit centres: entries picked by hash, then moved to the
    mean direction of a sample of SAMPLE_PER_CENTRE entries a centre."""
    wanted = max(1, min(MAX_CENTRES, math.isqrt(rows)))
    draw = F.xxhash64("entry", F.lit("centre"))
    sample = entries.orderBy(draw).limit(wanted * SAMPLE_PER_CENTRE).select("entry", "v")
    sample = materialize(sample, "centre-sample")
    picked = sample.orderBy(draw).limit(wanted).collect()
    centres = unit(np.array([r["v"] for r in picked], dtype=np.float64))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(centres.shape), np.zeros(len(centres), bool)
        for batch in batches:
            x = unit(_dense(batch.column(1), dim))
            cell = batch.column(2).flatten().to_numpy()
            np.add.at(total, cell, x)
            seen[cell] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.float64()))],
            names=["cell", "total"])

    for _ in range(rounds):
        parts = _with_cells(sample, centres, 1).mapInArrow(sums, "cell int, total array<double>")
        moved = parts.select("cell", F.posexplode("total").alias("at", "x")).groupBy(
            "cell", "at").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.array_sort(
                F.collect_list(F.struct("at", "x"))).alias("total"))
        centres = centres.copy()
        for r in moved.collect():  # one row per centre
            centres[r["cell"]] = [t["x"] for t in r["total"]]
        centres = unit(centres)
    return centres


def _best(q: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) positions of the k best members of each query, then by position."""
    out = []
    for at in range(0, len(q), QUERY_CHUNK):
        part = q[at:at + QUERY_CHUNK]
        floor = np.full(len(part), -np.inf)
        row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(m), MEMBER_CHUNK):
            s = part @ m[j:j + MEMBER_CHUNK].T
            if not j and s.shape[1] > k:
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                r, c = np.nonzero(s >= floor[:, None])
            else:  # a later one as good as the last kept loses by its position
                r, c = np.nonzero(s > floor[:, None])
            row, col = np.concatenate([row, r]), np.concatenate([col, c + j])
            score = np.concatenate([score, s[r, c]])
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            floor[row[place == k - 1]] = score[place == k - 1]
            row, col, score = row[place < k], col[place < k], score[place < k]
        out.append((row + at, col, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matches(queries: np.ndarray, q_ids, members: np.ndarray, m_ids, k: int) -> pd.DataFrame:
    order = np.argsort(m_ids, kind="stable")
    m_ids, double = m_ids[order], lambda x: unit(x.astype(np.float64))
    row, col, score = _best(double(queries), double(members[order]), k)
    return pd.DataFrame({"query": q_ids[row], "entry": m_ids[col], "cosine": score})


def matches_of_blocks(queries: DataFrame, members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query, entry, cosine): of each pair (q, m) of blocks the k best members of each query.
    Queries are (q, entry, v), members (m, entry, v)."""
    kind = members.schema["entry"].dataType.simpleString()

    def match(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "entry": [], "cosine": []})
        return _matches(np.stack(left["v_q"].to_list()), left["entry_q"].to_numpy(),
                        np.stack(right["v_m"].to_list()), right["entry_m"].to_numpy(), k)

    def sent(rows: DataFrame, side: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{side}") for c in ("q", "m", "entry", "v")]
        return rows.join(pairs, side).select(*named).groupBy(f"q_{side}", f"m_{side}")

    return sent(queries, "q").cogroup(sent(members, "m")).applyInPandas(
        match, f"query {kind}, entry {kind}, cosine double")


def block_size(rows: int) -> int:
    return min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(rows / BLOCKS)))


def exact_nearest(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, entry, cosine): k best entries of each query by brute force, in blocks."""
    spark = entries.sparkSession
    spread = lambda d, n, name: d.select(
        F.pmod(F.xxhash64("entry", F.lit("block")), F.lit(n)).cast("int").alias(name), "entry", "v")
    parts = []
    for d, name in ((queries, "q"), (entries, "m")):
        rows = d.count()
        n = max(1, math.ceil(rows / block_size(rows)))
        parts.append((spread(d, n, name), spark.range(n).select(F.col("id").cast("int").alias(name))))
    (q, q_blocks), (m, m_blocks) = parts
    return top_matches(matches_of_blocks(q, m, q_blocks.crossJoin(m_blocks), k), k)


def top_matches(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "entry"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def probes_for(entries: DataFrame, centres: np.ndarray, k: int, recall: float,
               queries: int = TUNING_QUERIES) -> int:
    """How many lists to read so that ``recall`` of the true neighbours of ``queries`` hashed
    entries lie in them."""
    some = materialize(entries.orderBy(F.xxhash64("entry", F.lit("tune"))).limit(queries), "tuning")
    truth = exact_nearest(entries, some, k + 1).where(F.col("query") != F.col("entry"))
    order = _with_cells(some, centres, len(centres)).select(F.col("entry").alias("_q"), "cells")
    home = _with_cells(entries, centres, 1).select(
        F.col("entry").alias("_m"), F.col("cells")[0].alias("cell"))
    places = (truth.join(home, F.col("entry") == F.col("_m")).join(order, F.col("query") == F.col("_q"))
              .select(F.array_position("cells", F.col("cell")).alias("place"))
              .groupBy("place").count().orderBy("place").collect())  # one row per list at most
    if not places:
        return 1
    share = np.cumsum([r["count"] for r in places]) / sum(r["count"] for r in places)
    return int(places[int(np.argmax(share >= recall - 1e-12))]["place"])


def nearest_rows(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
                 recall: float = 0.98, probes: int | None = None, block: int | None = None) -> DataFrame:
    """(id, rank, neighbour, cosine): the k nearest other rows of every row, rank from 1.

    Ties go to the smaller id. ``recall`` is what the lists read are chosen for; ``probes``
    sets their number instead, ``block`` that of entries in a block.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    entries, in_entry, dim = entries_of(vectors, key, vector, k)
    if not dim:
        return spark.createDataFrame([], f"id {kind}, rank int, neighbour {kind}, cosine double")
    n = entries.count()
    centres = fit_centres(entries, dim, n)
    probes = min(len(centres), probes or probes_for(entries, centres, k, recall))
    size = block or block_size(n)
    # Lists whose centres are nearest to the same one of a few make a group; blocks are its parts.
    heads = centres[:max(1, min(len(centres), math.ceil(n / size)))]
    groups = np.argmax(centres @ heads.T, axis=1)
    placed = materialize(_with_cells(entries, centres, probes, groups).select(
        "entry", "v", F.col("cells")[0].alias("group"), "cells"), "entry-groups")
    parts = materialize(placed.groupBy("group").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n")), "group-parts")
    part = F.pmod(F.xxhash64("entry", F.lit("part")), F.col("n")).cast("int")
    block_name = F.struct(F.col("group"), part.alias("part"))
    inside = placed.join(parts, "group").withColumn("q", block_name)
    found_groups = inside.select("q", F.explode("cells").alias("group")).distinct()
    pairs = materialize(found_groups.join(parts, "group").select("q", "group", F.explode(
        F.sequence(F.lit(0), F.col("n") - 1)).alias("part")).select(
            "q", F.struct("group", "part").alias("m")), "block-pairs")
    found = matches_of_blocks(inside.select("q", "entry", "v"),
                              inside.select(F.col("q").alias("m"), "entry", "v"), pairs, k + 1)
    found = top_matches(found.where(F.col("query") != F.col("entry")), k)
    # The copies of an entry come before all others, then each neighbour's ids in turn.
    ids = entries.select(F.col("entry").alias("_e"), "ids")
    near = found.join(ids, F.col("entry") == F.col("_e")).groupBy("query").agg(F.sort_array(
        F.collect_list(F.struct((-F.col("cosine")).alias("down"), F.col("entry").alias("e"), "ids"))
        ).alias("near"))  # k lists of k + 1 ids at most
    listed = ids.join(near, F.col("_e") == F.col("query"), "left")
    pairs = F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("down"), i.alias("id"))),
                     F.flatten(F.transform(F.coalesce("near", F.array().cast(
                         found_type(kind))), lambda e: F.transform(e["ids"], lambda i: F.struct(
                             e["down"].alias("down"), i.alias("id"))))))
    lists = materialize(listed.select("_e", F.slice(F.array_sort(pairs), 1, 2 * k + 2).alias("pairs")),
                        "neighbour-lists")
    own = in_entry.join(lists, F.col("entry") == F.col("_e")).select(
        "id", F.slice(F.filter("pairs", lambda p: p["id"] != F.col("id")), 1, k).alias("pairs"))
    return own.select("id", F.posexplode("pairs").alias("rank", "p")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("p")["id"].alias("neighbour"),
        (-F.col("p")["down"]).alias("cosine"))


def found_type(kind: str) -> str:
    return f"array<struct<down:double,e:{kind},ids:array<{kind}>>>"
