"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark.llm import prefix_trie

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    """rows: (conv_id, turn, role, text); turns of one conversation differ or are alike."""
    given = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            given[c].append(((t is not None, t or 0), role or "", text or ""))
    for c in given:
        given[c].sort()
    whole = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        turns = given.get(base, [])[:h] + own[h:]
        whole[c] = tuple((r, t) for _, r, t in turns)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (
            (len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        text = ",".join(map(str, sorted(ends[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None,
                    len(members[p]), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
         "saved_tokens", "ends_sha256")
key = lambda rows: sorted(rows, key=repr)


def trie(df):
    return [tuple(r[n] for n in NAMES) for r in prefix_trie.prefix_trie(df).collect()]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/conversations.parquet")
    assert key(trie(df)) == key(brute(map(tuple, df.collect())))


def shapes():
    rows = []
    for c in range(40):  # shared starts of different lengths, copies, a prefix of another
        for t in range(c % 9):
            rows.append((c, t, "user", f"t{t if t < c % 5 else (t, c % 3)}"))
        rows.append((c, 50, "user", "end"))
    for c in (200, 207, 300, 310):  # long, alike up to a turn beyond the first segments
        for t in range(200):
            rows.append((c, t, "assistant", "x" * (t % 7) if t != 150 or c != 310 else "other"))
    rows += [(500, t, "user", f"{t}") for t in range(64)]       # exactly one segment
    rows += [(600, t, "user", f"{t}") for t in range(128)]
    rows += [(502, 0, None, None), (502, None, "user", None), (502, 1, "user", "é\U0001f600")]
    rows += [(None, 0, "user", "nobody"), (-107, 0, "user", "a"), (-100, 1, "user", "b")]
    rows += [(901, 0, "user", "again")] * 3 + [(777, 0, "a", "only")]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_long_hot_and_odd_conversations(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rows = shapes() + [(c, t, "user", "hot") for c in range(1000, 1300) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert key(trie(df)) == key(brute(rows))


def test_small_blocks_merge_over_their_boundaries(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = shapes()
    df = spark.createDataFrame(rows, SCHEMA)
    try:
        for n in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert key(trie(df)) == key(brute(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_extra_columns_and_empty_tables(spark):
    rows = shapes()[:80]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df
    for name in ("level", "before", "keys", "rep", "node", "i", "_own", "_range", "n"):
        odd = odd.withColumn(name, F.lit("x"))
    assert key(trie(odd)) == key(brute(rows))
    assert trie(df.limit(0)) == [] and trie(df.where("conv_id IS NULL")) == []


def test_a_long_conversation_is_no_row(spark):
    rows = [(c, t, "user", f"{t}") for c in (5, 6) for t in range(1000)]
    cut = prefix_trie.segments(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))
    assert cut.agg(F.max(F.length("keys"))).first()[0] <= 16 * prefix_trie.SEGMENT
