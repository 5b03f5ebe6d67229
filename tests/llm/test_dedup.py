import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import with_clashes, EDGES, documents, edges, empty, sample
from pyspark.sql import functions as F

from txnspark.llm import exact_dedup, simhash
from txnspark.llm.components import connected_components
from txnspark.session import materialize

MASK = (1 << 64) - 1


def find_all(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# exact

def brute_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=repr)


def digest(found):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                   for r in found.collect()], key=repr)


@pytest.mark.parametrize("capacity", [3, 100_000])
def test_exact_equals_brute_force(spark, capacity):
    given = sample(spark, 150).union(sample(spark, 60).withColumn("doc_id", F.col("doc_id") + 9000))
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert digest(exact_dedup.exact_duplicates(given, capacity=capacity)) == brute_exact(rows)


def test_exact_edges(spark):
    assert digest(exact_dedup.exact_duplicates(edges(spark))) == brute_exact(EDGES)
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty(spark)).collect() == []


def test_one_row_of_each_text_stays(spark):
    given = edges(spark)
    kept = exact_dedup.drop_exact_duplicates(given)
    assert kept.columns == given.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len(
        {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in EDGES})


def test_directory_splits_and_every_hash_has_one_bucket(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("hash")).union(
        spark.range(500).select((F.lit(7 << 50) + F.col("id")).alias("hash")))  # a full prefix
    buckets = [(r["depth"], r["bucket"]) for r in exact_dedup.directory(entries, 100).collect()]
    assert len({d for d, _ in buckets}) > 2
    for r in entries.collect():
        h = r["hash"] & MASK
        assert sum(h >> (64 - d) == b for d, b in buckets) == 1


def test_texts_of_one_hash_are_chained(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    given = documents(spark, [(3, "a b", "en", "s"), (1, "a  b", "en", "s"), (2, "c", "en", "s")])
    keys, index = exact_dedup.build_index(given)
    assert sorted((r["chain"], r["keep_id"], r["group_size"]) for r in index.collect()) == [
        (1, 1, 2), (2, 2, 1)]


# simhash

def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(
        "[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42)
              for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_near(rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    ids = list(range(len(rows)))
    pairs = [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = find_all(pairs, ids)
    least = {}
    for i in ids:
        d = rows[i][0]
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted([(rows[i][0], f"{prints[i]:016x}", least.get(root[i])) for i in ids], key=repr)


def near_digest(df):
    return sorted([(r["doc_id"], r["f"], r["component_id"]) for r in df.withColumn(
        "f", simhash.fingerprint_hex(F.col("fp"))).collect()], key=repr)


def test_near_equals_brute_force(spark):
    given = sample(spark, 220)
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    for i, t in list(rows[:60]):
        words = t.split()
        for k in range(4):
            at = (i * 7 + k * 13) % len(words)
            rows.append((1000 + i * 10 + k, " ".join(words[:at] + ["changed"] + words[at + 1:])))
    table = documents(spark, [(i, t, "en", "s") for i, t in rows])
    found = near_digest(simhash.near_duplicates(table))
    assert found == brute_near(rows)
    assert len({f[2] for f in found}) < len(found) - 50
    kept = simhash.drop_near_duplicates(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({f[2] for f in found})


def test_near_edges(spark):
    rows = [r for r in EDGES]
    assert near_digest(simhash.near_duplicates(edges(spark))) == brute_near(rows)
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.drop_near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, simhash.drop_similar_documents])
def test_of_repeated_rows_one_stays(spark, drop):
    text = "one text of some twenty words " * 5
    rows = [(1, text, "en", "a")] * 3 + [(2, text.replace(" ", "  "), "en", "a"), (3, "other words", "en", "b"),
                                         (3, "other words", "en", "b"), (None, "no id", None, None),
                                         (None, "no id", None, None), (4, None, "en", "a")]
    kept = drop(with_clashes(documents(spark, rows, 4)))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (0, "no id"), (1, text), (3, "other words"), (4, "")]
    assert kept.columns == with_clashes(documents(spark, rows)).columns


def test_long_text_blocks(monkeypatch):
    text = EDGES[4][1]
    whole = simhash._fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 1000)
    assert simhash._fingerprint(text) == whole
    assert whole & MASK == brute_fingerprint(text)


def test_links_are_exactly_the_close_pairs(spark):
    rng = np.random.default_rng(3)
    prints = {0, MASK}
    for _ in range(60):
        base = int(rng.integers(0, 2 ** 63)) * 2 + int(rng.integers(0, 2))
        prints.add(base)
        for flips in (1, 1, 2, 2, 3, 3, 4, 5):
            p = base
            for b in rng.choice(64, flips, replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = [tuple(sorted((r["a"] & MASK, r["b"] & MASK)))
           for r in simhash.fingerprint_links(table).collect()]
    want = {(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def five_words(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_probes_are_never_broadcast(spark):
    # Spark sizes a table after an explode as if it had no more rows than before.
    table = materialize(spark.range(2000).select(F.xxhash64("id").alias("fp")), "test-prints")
    plan = simhash.fingerprint_links(table)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "BroadcastExchange" not in plan


def test_bucket_keys_are_written_before_they_are_joined(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.setdefault(
        name, materialize(df, name)))
    simhash.similar_documents(sample(spark, 60)).count()
    nodes, keys = written["nodes"], written["spread-keys"]
    assert keys.count() == nodes.select(F.explode("keys")).count() > nodes.count()


def test_stage_finds_every_pair_of_jaccard_four_fifths(spark):
    import corpus_pipeline
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").collect()]
    # A chain (each text like the next, its ends not alike) and pairs just under the bound.
    words = [f"w{i}" for i in range(200)]
    docs += [(2000 + k, " ".join(f"x{i}" if i < 15 * k else w for i, w in enumerate(words)))
             for k in range(6)]
    docs += [(3000, "one two"), (3001, "One  two"), (3002, "one"), (3003, ""), (3004, None)]
    sets = [five_words(t) for _, t in docs]
    holders = {}
    for at, shingles in enumerate(sets):
        for x in shingles:
            holders.setdefault(x, []).append(at)
    pairs = {p for at in holders.values() for p in combinations(at, 2)}
    pairs = {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    pairs.add((len(docs) - 2, len(docs) - 1))
    root = find_all(pairs, range(len(docs)))
    table = documents(spark, [(i, t, "en", "s") for i, t in docs])
    kept = sorted(r["doc_id"] for r in stage(spark, table, "").collect())
    assert kept == sorted({docs[r][0] for r in root.values()})
    assert 56 not in kept and 2001 not in kept and 3001 not in kept and 3002 in kept


@pytest.mark.parametrize("original", [True, False])
def test_large_near_group_and_common_passage(spark, original):
    """Copies at about 0.8 of each other and a passage in many texts: every link, few candidates."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(220)]
    docs = [" ".join(words)] if original else []
    for k in range(250):
        copy = list(words)
        for at in rng.integers(0, 220, 3):
            copy[at] = f"c{k}_{at}"
        docs.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [" ".join(f"o{k}_{i}" for i in range(20)) + " " + passage for k in range(250)]
    sets = [five_words(t) for t in docs]
    pairs = [(a, b) for a, b in combinations(range(len(docs)), 2)
             if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = find_all(pairs, range(len(docs)))
    found = simhash.similar_documents(
        documents(spark, [(i, t, "en", "s") for i, t in enumerate(docs)]))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == root


def test_a_common_passage_makes_no_candidates(spark):
    nodes = spark.createDataFrame([(k, k) for k in range(500)], "fp long, root long")
    sets = spark.createDataFrame(
        [(k, [-k * 1000 - i - 1 for i in range(30)] + list(range(70))) for k in range(500)],
        "fp long, set array<long>")
    assert simhash._unsettled_pairs(nodes, sets).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    pairs = {"random": [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(220)],
             "chain": [(i + 1, i) for i in range(70)], "star": [(9, i) for i in range(200)],
             "none": []}[shape]
    found = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = find_all(pairs, {x for p in pairs for x in p})
    assert found == {n: want[n] for n in linked}
