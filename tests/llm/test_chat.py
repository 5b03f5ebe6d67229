import hashlib

import pytest
from helpers import with_clashes
from pyspark.sql import functions as F

from txnspark.llm.chat import escape, prefix_tree, read_back, unescape

HARD = [r"\### Assistant: </turn> ok", "<turn user>\n", "</turn>\n", "\\", "\\\\<", ">\n", "",
        "a\\", "<|endoftext|>", "\0 x", "日本 \U0001f600", "\\<\\>", "x" * 20_000]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        form = sum(len(escape(r)) + len(escape(t)) + 16 for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(said),
                     hashlib.sha256(said.encode()).hexdigest(), form)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(nodes, members):
    return {r["conv_id"]: tuple(r)[1:] for r in read_back(nodes, members).collect()}


def check_tree(nodes):
    rows = sorted(nodes.collect(), key=lambda r: r["stream_start"])
    at = 0
    for r in rows:
        assert r["stream_start"] == at  # one stream without a gap, each segment once
        at += r["n_tokens"]
        assert len(r["ids"]) == 4 * r["n_tokens"]
        assert r["position"] == sum(a["end"] - a["start"] for a in r["ancestors"])
        assert all(a["end"] <= r["stream_start"] for a in r["ancestors"])
    assert len({r["node"] for r in rows}) == len(rows)
    # Depth-first: the turns above a node are the ones still open, and nothing else.
    open_ = []
    for r in rows:
        open_ = open_[:r["depth"]]
        assert len(open_) == r["depth"]
        joined = []
        for a, b in open_:
            if joined and joined[-1][1] == a:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        assert [[a["start"], a["end"]] for a in r["ancestors"]] == joined
        open_.append((r["stream_start"], r["stream_start"] + r["n_tokens"]))
    return rows


def test_escapes_are_reversible():
    for t in HARD:
        assert unescape(escape(t)) == t and "</turn>" not in escape(t).replace("\\<", "")


def test_tables_come_back(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    nodes, members = prefix_tree(given)
    assert got(nodes, members) == brute(rows)
    check_tree(nodes)


@pytest.mark.parametrize("n", [1, 8])
def test_shared_turns_are_emitted_once(spark, shuffle_partitions, n):
    shuffle_partitions(n)
    rows = []
    for conv in range(120):
        rows.append((conv, 0, "user", "hi" if conv % 3 else f"hello {conv % 4}"))
        rows.append((conv, 1, "assistant", f"answer {conv % 5}"))
        for t in range(conv % 4):
            rows.append((conv, 2 + t, "user", f"more {(conv * t) % 3}"))
    nodes, members = prefix_tree(table(spark, rows))
    assert got(nodes, members) == brute(rows)
    paths = set()
    for conv in range(120):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        paths |= {tuple(turns[:i + 1]) for i in range(len(turns))}
    assert len(check_tree(nodes)) == len(paths)


def test_hard_texts_and_edges(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(HARD)]
    rows += [(i, 1, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(100 + i, 0, t[:50], "role") for i, t in enumerate(HARD)]
    rows += [(200, None, None, None), (200, 0, "assistant", "b"), (200, 0, "assistant", "b"),
             (201, 0, "assistant", None), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    given = with_clashes(table(spark, rows)).withColumn("node", F.lit(1))
    nodes, members = prefix_tree(given)
    assert got(nodes, members) == brute(rows)
    nodes, members = prefix_tree(given.limit(0))
    assert nodes.collect() == [] and got(nodes, members) == {}
