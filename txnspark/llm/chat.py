"""Chat formatting as a prefix tree: shared first turns are emitted once.

A turn becomes one segment of token ids: ``<turn role>`` newline, the text, ``</turn>``
newline. Control strings inside roles and texts are escaped, so the format can be read
back. Conversations that start with the same turns share those segments. Segments are laid
out depth-first in one stream; each carries the position of its first token (tokens of its
ancestors) and the stream intervals of its ancestors, which are all it attends to besides
itself.

Depth-first order needs no walk: with the different conversations sorted by their list of
turn hashes, a turn is new exactly beyond the prefix shared with the conversation before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import let
from txnspark.llm.tokens import default_tokenizer, tokenizer
from txnspark.session import materialize

OPEN, CLOSE, TURN_END = "<turn ", ">\n", "</turn>\n"
LOSS_ROLE = "assistant"
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*+)>\n", re.S)  # up to the first > not escaped


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, and each < or > of a text gets one before it."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out.append(text[at:cut])
        out.append(text[cut + 1])
        at = cut + 2
    return "".join([*out, text[at:]])


def _plain_ids(tok, text: str) -> np.ndarray:
    """Ids of a text with the tokenizer's own control strings taken as ordinary text."""
    return np.asarray(tok.single.encode_ordinary(text), dtype="<u4")


def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = _plain_ids(tok, TURN_END)
        for batch in batches:
            names = batch.schema.names
            ids, starts, lengths, totals, sizes = [], [], [], [], []
            for role, text in zip(batch.column(names.index("role")).to_pylist(),
                                  batch.column(names.index("text")).to_pylist()):
                head = OPEN + escape(role) + CLOSE
                safe = escape(text)
                first, body = _plain_ids(tok, head), _plain_ids(tok, safe)
                ids.append(np.concatenate([first, body, end]).astype("<u4").tobytes())
                starts.append(len(first))
                lengths.append(len(body) if role == LOSS_ROLE else 0)
                totals.append(len(first) + len(body) + len(end))
                sizes.append(len(head) + len(safe) + len(TURN_END))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("turn_key")), pa.array(ids, pa.binary()),
                 pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(sizes, pa.int64())],
                names=["turn_key", "ids", "loss_start", "loss_length", "n_tokens", "n_chars"])
    return run


def _shared(p: Column, q: Column) -> Column:
    """Number of leading entries two lists share."""
    same = F.zip_with(p, q, lambda a, b: a.eqNullSafe(b))
    miss = F.array_position(same, False)
    return F.when(q.isNull(), F.lit(0)).when(miss > 0, miss - 1).otherwise(
        F.size(same)).cast("int")


def prefix_tree(conversations: DataFrame,
                tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members), both written tables.

    nodes: node (key of the path), turn_key, role, depth, stream_start, n_tokens, position
    (of the first token), ancestors (stream intervals start, end of the turns above it, those
    next to each other joined), ids (binary, little-endian 32-bit), loss_start, loss_length (ids under the loss mask), n_chars.
    members: (conv_id, path): the node keys of each conversation from the first turn on.

    Rows of one conv_id are one conversation, in order of turn (nulls first), then role,
    then a hash of role and text. A null text or role is empty; rows of a null conv_id form one conversation.
    Repeated rows are turns of their own. Texts may be of any length; a conversation
    must fit in a task. Other columns are not read. Empty tables give empty tables.
    """
    path = tokenizer_path or default_tokenizer()
    turns = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The role's length keeps role and text apart.
    turns = turns.withColumn("turn_key", F.substring(F.sha2(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    segments = materialize(
        turns.groupBy("turn_key", "role", "text").agg(F.count(F.lit(1)).alias("n")).drop("n")
        .mapInArrow(_segments(path), "turn_key string, ids binary, loss_start long, "
                    "loss_length long, n_tokens long, n_chars long"), "segments")
    lists = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "turn", "role", "turn_key"))), lambda t: t["turn_key"]).alias("keys"))
    lists = materialize(lists, "conversations")
    # Equal conversations once; sorted in ranges, each written by its own task.
    ordered = lists.select("keys").distinct().repartitionByRange("keys").sortWithinPartitions(
        "keys").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    last = ordered.groupBy("part").agg(F.max("keys").alias("last")).select(
        (F.col("part")).alias("_part"),
        F.lag("last").over(W.orderBy("part")).alias("_last"))  # one row per range
    inside = W.partitionBy("part").orderBy("keys")
    ordered = (ordered.join(last, F.col("part") == F.col("_part"))
               .withColumn("_before", F.coalesce(F.lag("keys").over(inside), F.col("_last")))
               .withColumn("shared", _shared(F.col("keys"), F.col("_before"))))
    # A node is named by the chain of the keys down to it.
    chain = F.aggregate(
        "keys", F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda a, k: let(F.substring(F.sha2(F.concat(a["last"], k), 256), 1, 32), lambda h: F.struct(
            h.alias("last"), F.concat(a["all"], F.array(h)).alias("all"))))["all"]
    ordered = materialize(ordered.select("part", "keys", "shared", chain.alias("path")), "paths")
    members = materialize(
        lists.select("conv_id", "keys", chain.alias("path")).select("conv_id", "path"),
        "members")
    return _lay_out(ordered, segments), members


_INTERVALS = "array<struct<start:bigint,end:bigint>>"


def _extended(intervals: Column, start: Column, end: Column) -> Column:
    """Intervals with one more at the end, joined to the last if it begins where that ends."""
    last = F.get(intervals, F.size(intervals) - 1)
    more = lambda s: F.array(F.struct(s.alias("start"), end.alias("end")))
    return F.when(last["end"] == start, F.concat(
        F.slice(intervals, 1, F.size(intervals) - 1), more(last["start"]))).otherwise(
        F.concat(intervals, more(start)))


def _lay_out(ordered: DataFrame, segments: DataFrame) -> DataFrame:
    """Stream places of all nodes of the sorted conversations."""
    sizes = segments.select(F.col("turn_key").alias("_key"), "n_tokens")
    # Lengths of all turns of each different conversation, in order; the last node of its
    # path stands for the conversation, so no row carries a path along.
    named = ordered.withColumn("leaf", F.element_at("path", -1))
    lengths = (named.select(F.col("leaf").alias("_leaf"),
                            F.posexplode("keys").alias("depth", "turn_key"))
               .join(sizes, F.col("turn_key") == F.col("_key"))
               .groupBy("_leaf")
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "n_tokens"))),
                                lambda x: x["n_tokens"]).alias("lengths")))
    measured = named.join(lengths, F.col("leaf") == F.col("_leaf")).drop("_leaf")
    own = F.aggregate(F.slice("lengths", F.col("shared") + 1, F.size("lengths")),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    measured = materialize(measured.withColumn("own", own), "measured")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = measured.groupBy("part").agg(F.sum("own").alias("n")).select(
        F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # one row per range
    inside = W.partitionBy("part").orderBy("keys").rowsBetween(W.unboundedPreceding, -1)
    placed = (measured.join(parts, F.col("part") == F.col("_part"))
              .withColumn("base", F.col("_base") + F.coalesce(F.sum("own").over(inside),
                                                              F.lit(0))))
    # Running sums over the turns: positions, and stream starts of the new ones.
    places = F.aggregate(
        F.sequence(F.lit(0), F.size("lengths") - 1),
        F.struct(F.lit(0).cast("long").alias("position"), F.col("base").alias("at"),
                 F.array().cast("array<struct<depth:int,position:bigint,stream_start:bigint,"
                                "node:string,turn_key:string,n_tokens:bigint>>").alias("all")),
        lambda a, i: F.struct(
            (a["position"] + F.get("lengths", i)).alias("position"),
            (a["at"] + F.when(i >= F.col("shared"), F.get("lengths", i)).otherwise(0)).alias("at"),
            F.when(i >= F.col("shared"), F.concat(a["all"], F.array(F.struct(
                i.alias("depth"), a["position"].alias("position"),
                a["at"].alias("stream_start"), F.get("path", i).alias("node"),
                F.get("keys", i).alias("turn_key"), F.get("lengths", i).alias("n_tokens")))))
            .otherwise(a["all"]).alias("all")))["all"]
    placed = materialize(placed.select("leaf", "base", F.slice("path", 1, F.col("shared"))
                                       .alias("shared_path"), places.alias("places")), "placed")
    new = placed.select("leaf", "base", F.explode("places").alias("place")).select(
        "leaf", "base", "place.*")
    spans = new.select(F.col("node").alias("_node"), "stream_start",
                       (F.col("stream_start") + F.col("n_tokens")).alias("stream_end"))
    # The turns a conversation shares, once for all its new ones, as intervals without gaps:
    # as many rows as it has shared turns, and as many intervals as its path has branches.
    above = (placed.select(F.col("leaf").alias("_leaf"),
                           F.posexplode("shared_path").alias("level", "up"))
             .join(spans, F.col("up") == F.col("_node"))
             .groupBy("_leaf").agg(F.aggregate(
                 F.sort_array(F.collect_list(F.struct("level", "stream_start", "stream_end"))),
                 F.array().cast(_INTERVALS),
                 lambda a, x: _extended(a, x["stream_start"], x["stream_end"])).alias("above")))
    none = F.coalesce("above", F.array().cast(_INTERVALS))
    own = F.when(F.col("stream_start") > F.col("base"), _extended(
        none, F.col("base"), F.col("stream_start"))).otherwise(none)
    return materialize(
        new.join(above, F.col("leaf") == F.col("_leaf"), "left")
        .withColumn("ancestors", own).drop("leaf", "_leaf", "base", "above", "n_tokens")
        .join(segments.withColumnRenamed("turn_key", "_key"), F.col("turn_key") == F.col("_key"))
        .drop("_key"), "nodes")


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
          "loss_sha256 string, formatted_chars long")


def _turn(raw: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head = _HEAD.match(raw)
    return unescape(head.group(1)), unescape(raw[head.end():-len(TURN_END)])


def read_back(nodes: DataFrame, members: DataFrame,
              tokenizer_path: str | None = None) -> DataFrame:
    """Digests of each conversation, read from the emitted ids along its path."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        decode = lambda ids: tok.single.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")
        for batch in batches:
            rows = []
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                chars = masked = 0
                for segment in segments:
                    ids = np.frombuffer(segment["ids"], dtype="<u4")
                    raw = decode(ids)
                    role, text = _turn(raw)
                    chars += len(raw)
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    a, n = segment["loss_start"], segment["loss_length"]
                    if n:
                        said = unescape(decode(ids[a:a + n]))
                        masked += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                rows.append((conv, len(segments), turns.hexdigest(), masked, loss.hexdigest(),
                             chars))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                columns, _ARROW)], schema=_ARROW)

    steps = members.select("conv_id", F.posexplode("path").alias("depth", "_node"))
    body = nodes.select("node", "ids", "loss_start", "loss_length")
    gathered = (steps.join(body, F.col("_node") == F.col("node"))
                .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
                    "depth", "ids", "loss_start", "loss_length"))).alias("segments")))
    return gathered.select(F.col("conv_id").cast("long"), "segments").mapInArrow(run, DIGEST)


_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string())
                    for c in DIGEST.split(", ")])
