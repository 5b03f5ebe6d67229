"""Trie of conversation prefixes by union-find over the common prefixes of sorted neighbours.

Conversations are cut into segments of ``SEGMENT`` turns, so no row grows with a conversation;
a segment is known by the hash of all turns before it and the keys of its own. Equal segments
are one item. Items are sorted in ranges, and each block of a range builds its forest on its
own: neighbours are edges weighted with the length of their common prefix, edges are joined in
descending order, and each join of components at a depth makes the branching node there; the
turns passed on the way up are its unary nodes. Nodes that touch a block's first or last item
may go on in the next block: only these are exchanged, and merged by the hash of their prefix,
as are the last turn of a full segment and the top of the segments that follow it.

A prefix hash is the sum, in four lanes modulo 2**32, of 128-bit hashes of (position, role,
text), so it can be carried over segments by running sums.

Sums over subtrees need no walk over segments: the smallest conversation of a node stays the
smallest on its own path below, so each conversation owns the lower end of its path. With the
characters before that end as its weight, the tokens saved below a node are the weights of its
members, less its own prefix for all but one member, less the weight of its owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.operators.ordered import prefix_sum
from txnspark.session import materialize

SEGMENT = 64
HEADS = 5  # turns a rebuilt conversation can take from another
_LOW = 0xFFFFFFFF


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def _taken(conv: Column) -> Column:
    """How many first turns of ``conv`` are another conversation's."""
    return F.crc32(conv.cast("string").cast("binary")) % (HEADS + 1)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, two content hashes and the code points of each row; no texts."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.length(text).cast("long").alias("chars"))


ORDER_BY = ["turn", "role", "c1", "c2", "chars"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, c1, c2, chars): turns of the rebuilt conversations, i from 0.

    Each conversation also has a row with i = -1 and nothing else, so none is lost.
    """
    turns = turns_of(conversations)
    conv = F.col("conv_id")
    # Spark limits each group in the scan tasks, so a long conversation sends a few rows only.
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(
        *[F.col(c).asc_nulls_first() for c in ORDER_BY]))
    heads = (turns.where(conv % 100 == 0).withColumn("_rank", rank)
             .where(F.col("_rank") <= HEADS)
             .withColumnRenamed("conv_id", "_base"))
    every = materialize(turns.select("conv_id").distinct(), "conversation-ids")
    # At most a hundred conversations have one base.
    taken = every.join(heads, (conv - conv % 100 == F.col("_base"))
                       & (F.col("_rank") <= _taken(conv)))
    taken = taken.select("conv_id", F.lit(0).alias("_own"), F.col("_rank").alias("_rank"),
                         *ORDER_BY)
    own = turns.select("conv_id", F.lit(1).alias("_own"), F.lit(0).alias("_rank"), *ORDER_BY)
    both = taken.union(own).withColumn("_head", (1 - F.col("_own")).cast("long")).withColumn(
        "_one", F.col("_own").cast("long"))
    # One ordered scan numbers both kinds, the taken turns first; a long conversation spreads
    # over many ranges.
    numbered = prefix_sum(both, ["_own", "_rank", *ORDER_BY],
                          {"_heads": "_head", "_owns": "_one"}, group_by=["conv_id"])
    after = F.col("_owns") - 1 - _taken(conv)  # place among the own turns that stay
    rows = numbered.where((F.col("_own") == 0) | (after >= 0)).select(
        "conv_id", (F.col("_heads") + F.when(F.col("_own") == 0, F.lit(-1)).otherwise(after))
        .cast("long").alias("i"), "c1", "c2", "chars")
    none = F.lit(None).cast("long")
    return rows.union(every.select("conv_id", F.lit(-1).cast("long"), none, none, none))


def segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and SEGMENT turns, written.

    level, before and after (prefix hashes), keys (16 bytes a turn), lens (code points), depth
    (turns up to its end), chars_before, total (code points up to its end), more (whether the
    conversation goes on).
    """
    i = F.col("i")
    keyed = turns.withColumn("_m1", F.xxhash64(F.lit(3), "i", "c1")).withColumn(
        "_m2", F.xxhash64(F.lit(4), "i", "c2"))
    level = F.floor(F.greatest(i, F.lit(0).cast("long")) / SEGMENT).cast("int")
    lanes = []
    for m in ("_m1", "_m2"):
        lanes += [F.call_function("shiftrightunsigned", F.col(m), F.lit(32)),
                  F.col(m).bitwiseAND(F.lit(_LOW))]
    turn = F.struct("i", F.concat(_hex(F.col("_m1"), 16), _hex(F.col("_m2"), 16)).alias("key"),
                    "chars")
    cut = keyed.groupBy("conv_id", level.alias("level")).agg(
        F.sort_array(F.collect_list(F.when(i >= 0, turn))).alias("_turns"),  # SEGMENT at most
        *[F.coalesce(F.sum(F.when(i >= 0, x)), F.lit(0).cast("long")).alias(f"_s{k}")
          for k, x in enumerate(lanes)],
        F.coalesce(F.sum("chars"), F.lit(0).cast("long")).alias("_chars"))
    # Over the segments of a conversation: a SEGMENT-th of its turns.
    to_here = W.partitionBy("conv_id").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    for k in range(4):
        cut = cut.withColumn(f"_t{k}", F.sum(f"_s{k}").over(to_here))
    cut = cut.withColumn("total", F.sum("_chars").over(to_here)).withColumn(
        "more", F.lead("level").over(W.partitionBy("conv_id").orderBy("level")).isNotNull())
    hashed = lambda part: F.unhex(F.concat(*[
        _hex(part(k).bitwiseAND(F.lit(_LOW)), 8) for k in range(4)]))
    return materialize(cut.select(
        "conv_id", "level",
        hashed(lambda k: F.col(f"_t{k}") - F.col(f"_s{k}")).alias("before"),
        hashed(lambda k: F.col(f"_t{k}")).alias("after"),
        F.unhex(F.array_join(F.transform("_turns", lambda t: t["key"]), "")).alias("keys"),
        F.transform("_turns", lambda t: t["chars"]).alias("lens"),
        (F.col("total") - F.col("_chars")).alias("chars_before"), "total", "more"), "segments")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in sorted (node, conv_id) rows, as comma-joined text."""
    for batch in batches:
        nodes, convs = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        cuts = [k for k in range(1, len(nodes)) if nodes[k] != nodes[k - 1]]
        spans = list(zip([0, *cuts], [*cuts, len(nodes)])) if nodes else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[a] for a, _ in spans], pa.binary()),
             pa.array([int(convs[a]) for a, _ in spans], pa.int64()),
             pa.array([",".join(map(str, convs[a:b].tolist())) for a, b in spans], pa.string())],
            names=["_end", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order; only the hash is held."""
    names, state, node = ["_end", "ends"], None, None

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()),
                                           pa.array([p[1] for p in pairs], pa.string())], names=names)
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == node:
                state.update(b",")
            else:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield out(done)
    if state:
        yield out([(node, state.hexdigest())])


def end_digests(cut: DataFrame) -> DataFrame:
    """(_end, ends): digest of the conversations that end at each prefix.

    The ids are joined to text in ranges first, so a frequent end reaches its hash, which has
    to see them in order, as a few long rows.
    """
    ends = cut.where(~F.col("more")).select(F.col("after").alias("_end"), "conv_id")
    chunks = (ends.repartitionByRange("_end", "conv_id").sortWithinPartitions("_end", "conv_id")
              .mapInArrow(_chunks, "_end binary, first long, ids string"))
    return (chunks.repartition("_end").sortWithinPartitions("_end", "first")
            .mapInArrow(_digests, "_end binary, ends string"))


def items_of(cut: DataFrame) -> DataFrame:
    """Different segments with their numbers of conversations, written."""
    items = cut.groupBy("level", "before", "after").agg(
        F.any_value("keys").alias("keys"), F.any_value("lens").alias("lens"),
        F.any_value("chars_before").alias("chars_before"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("more").cast("long")).alias("n_more"),
        F.min("conv_id").alias("rep"))
    return materialize(items.join(end_digests(cut), F.col("after") == F.col("_end"), "left")
                       .drop("_end"), "items")


NODE = ("depth long, node binary, parent binary, rep long, n long, closed long, weight long, "
        "leaves long, rep_weight long, ends string, chars_above long, open boolean, spine boolean")
_NODE = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
                                   "boolean": pa.bool_()}[c.split()[1]]) for c in NODE.split(", ")])
_ITEM = ["level", "before", "keys", "lens", "chars_before", "n", "n_more", "rep", "ends",
         "weight", "leaves", "rep_weight"]


class _Component:
    """Neighbouring items joined so far, and the node they have reached."""

    __slots__ = ("lo", "hi", "depth", "n", "rep", "weight", "leaves", "rep_weight", "closed",
                 "ends", "more")

    def __init__(self, at, depth, n, rep, weight, leaves, rep_weight, ends, more):
        self.lo = self.hi = at
        self.depth, self.n, self.rep, self.weight = depth, n, rep, weight
        self.leaves, self.rep_weight, self.closed = leaves, rep_weight, 0
        self.ends, self.more = ends, more


def common_prefixes(keys: list[bytes], trees: list[tuple]) -> np.ndarray:
    """Turns each item shares with the one before; -1 for another tree."""
    out = np.full(len(keys), -1)
    for k in range(1, len(keys)):
        if trees[k] == trees[k - 1]:
            a, b = keys[k - 1], keys[k]
            n = min(len(a), len(b)) // 16
            if n:
                x = np.frombuffer(a, "<u8", 2 * n) != np.frombuffer(b, "<u8", 2 * n)
                miss = int(x.argmax())
                n = miss // 2 if x[miss] else n
            out[k] = n
    return out


def block_forest(rows: dict[str, list]) -> tuple[list, list]:
    """Chains of nodes of one sorted block: (item, bottom, top, component values), and tops."""
    last = len(rows["keys"]) - 1
    comps = [_Component(k, len(keys) // 16, *values, more > 0 and len(keys) // 16 == SEGMENT)
             for k, (keys, more, *values) in enumerate(zip(
                 rows["keys"], rows["n_more"], rows["n"], rows["rep"], rows["weight"],
                 rows["leaves"], rows["rep_weight"], rows["ends"]))]
    parent = list(range(last + 1))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    chains: list[tuple] = []

    def raise_to(c: _Component, depth: int) -> None:
        """Emits the nodes below ``depth``, each the only one of its depth in the component."""
        if c.depth > depth:
            spine = c.lo == 0 or c.hi == last
            chains.append((c.lo, c.depth, depth + 1, c.rep, c.n, c.closed, c.weight, c.leaves,
                           c.rep_weight, c.ends, c.more, spine))
            c.depth, c.closed, c.ends, c.more = depth, int(not spine), None, False

    shared = common_prefixes(rows["keys"], list(zip(rows["level"], rows["before"])))
    for k in np.argsort(-shared, kind="stable"):
        depth = int(shared[k])
        if depth < 0:
            break
        a, b = find(k - 1), find(k)
        left, right = comps[a], comps[b]
        raise_to(left, depth)
        raise_to(right, depth)
        parent[b] = a
        left.hi = right.hi
        left.n, left.closed = left.n + right.n, left.closed + right.closed
        left.weight, left.leaves = left.weight + right.weight, left.leaves + right.leaves
        if right.rep < left.rep:
            left.rep, left.rep_weight = right.rep, right.rep_weight
        left.ends, left.more = left.ends or right.ends, left.more or right.more
    tops = [comps[k] for k in range(last + 1) if parent[k] == k]
    for c in tops:
        raise_to(c, 0)
    return chains, tops


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each block. ``open`` ones may be part of a node that other blocks have too."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(k).to_pylist() for k, name in enumerate(_ITEM)}
        chains, tops = block_forest(rows)
        out: list[list] = [[] for _ in _NODE]
        for (at, bottom, top, rep, n, closed, weight, leaves, rep_weight, ends, more,
             spine) in chains:
            depths = range(bottom, top - 1, -1)
            lanes = np.frombuffer(rows["keys"][at], ">u4", 4 * bottom).reshape(-1, 4)
            start = np.frombuffer(rows["before"][at], ">u4").astype(np.uint32)
            sums = np.vstack([start, start + np.cumsum(lanes, axis=0, dtype=np.uint32)])
            raw = sums.astype(">u4").tobytes()
            hashes = [raw[16 * k:16 * k + 16] for k in range(bottom + 1)]
            above = np.cumsum([rows["chars_before"][at], *rows["lens"][at][:bottom]]).tolist()
            m, base = len(depths), SEGMENT * rows["level"][at]
            for column, values in zip(out, (
                    [base + d for d in depths], [hashes[d] for d in depths],
                    [hashes[d - 1] for d in depths], [rep] * m, [n] * m,
                    [closed] + [int(not spine)] * (m - 1), [weight] * m, [leaves] * m,
                    [rep_weight] * m, [ends] + [None] * (m - 1), [above[d - 1] for d in depths],
                    [spine or more] + [spine] * (m - 1), [spine] * m)):
                column.extend(values)
        for c in tops:
            # The root; or what follows a full segment, whose conversations count there.
            first = rows["level"][c.lo] == 0
            values = (SEGMENT * rows["level"][c.lo], rows["before"][c.lo], None,
                      c.rep if first else None, c.n if first else 0, c.closed,
                      c.weight if first else 0, c.leaves if first else 0,
                      c.rep_weight if first else None, c.ends if first else None,
                      0 if first else None, True, False)
            for column, value in zip(out, values):
                column.append(value)
        for i in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[i:i + 50_000], f.type) for c, f in zip(out, _NODE)], schema=_NODE)


def forest(items: DataFrame, name: str) -> DataFrame:
    """All nodes, written: those closed in their block, and the open ones merged."""
    key = ["level", "before", "keys"]
    each = materialize(items.select(*_ITEM).repartitionByRange(*key).sortWithinPartitions(*key)
                       .mapInArrow(_forest, NODE), f"{name}-blocks")
    kept = ["depth", "node", "parent", "rep", "n", "n_children", "weight", "leaves",
            "rep_weight", "ends", "chars_above"]
    merged = materialize(each.where("open").groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("rep").alias("rep"),
        F.sum("n").alias("n"), F.sum("closed").alias("closed"), F.sum("weight").alias("weight"),
        F.sum("leaves").alias("leaves"), F.min(F.when(F.col("rep").isNotNull(), F.struct(
            "rep", "rep_weight"))).alias("_least"), F.max("ends").alias("ends"),
        F.max("chars_above").alias("chars_above"), F.max("spine").alias("spine")), f"{name}-open")
    # A child that several blocks have is counted once, here.
    parts = merged.where(F.col("spine") & F.col("parent").isNotNull()).groupBy(
        F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("_more"))
    joined = merged.join(parts, F.col("node") == F.col("_of"), "left").withColumn(
        "n_children", F.col("closed") + F.coalesce("_more", F.lit(0))).withColumn(
        "rep_weight", F.col("_least")["rep_weight"])
    return materialize(each.where(~F.col("open")).withColumnRenamed("closed", "n_children")
                       .select(*kept).union(joined.select(*kept)), name)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and prefix_hash (16 bytes), which names the node.

    Rows of a null conv_id belong to no conversation and are left out. Turns of one conversation
    are ordered by turn (nulls first), then by role and a hash of role and text, so ties have one
    order; repeated rows are turns of their own. Null roles and texts are empty, texts are read
    whole, conversations may have any number of turns. Other columns are not read. An empty
    table has no root and no rows.
    """
    cut = segments(rebuilt(conversations))
    items = items_of(cut)
    zero = F.lit(0).cast("long")
    shape = forest(items.withColumns({"weight": zero, "leaves": zero, "rep_weight": zero}), "shape")
    owners = shape.groupBy(F.col("rep").alias("_owner")).agg(
        F.min("chars_above").alias("_from"),
        F.max((F.col("n_children") == 0).cast("long")).alias("_leaf"))
    owners = materialize(owners, "owners")
    ends = cut.where(~F.col("more")).select(F.col("conv_id").alias("_conv"), F.col("total").alias("_total"))
    weights = materialize(
        ends.join(owners, F.col("_conv") == F.col("_owner"), "left").select(
            "_conv", F.coalesce("_from", "_total").alias("_weight"),
            F.coalesce("_leaf", zero).alias("_leaf")), "weights")
    per_item = cut.select("conv_id", "after").join(weights, F.col("conv_id") == F.col("_conv")).groupBy(
        F.col("after").alias("_item")).agg(
        F.sum("_weight").alias("weight"), F.sum("_leaf").alias("leaves"),
        F.min(F.struct("conv_id", "_weight"))["_weight"].alias("rep_weight"))
    nodes = forest(items.join(per_item, F.col("after") == F.col("_item")).drop("_item"), "nodes")
    above = nodes.select(F.col("node").alias("_node"), F.col("rep").alias("parent_conv_id"))
    saved = (F.col("weight") - (F.col("n") - 1) * F.col("chars_above") - F.col("rep_weight"))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(above, F.col("parent") == F.col("_node"), "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends", F.lit(empty)).alias("ends_sha256"), F.col("node").alias("prefix_hash"))
