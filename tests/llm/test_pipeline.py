import re

import __spark_entry__
import corpus_pipeline
import pytest
from helpers import EDGES, edges, empty
from test_dedup import find_all, five_words
from test_packing import check as check_pieces
from tokenizers import Tokenizer

from txnspark.llm.tokens import default_tokenizer
from txnspark.session import materialize

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_one_by_one(spark):
    from test_mixing import brute_targets
    from txnspark.llm import quality_rules
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == before.columns
        seen[name] = (rows_of(before), docs)
    given, after = seen["quality_rules"]
    bad = {r["doc_id"] for r in quality_rules.quality_verdicts(
        spark.read.parquet(f"{SF}/documents.parquet")).collect() if not r["kept"]}
    assert bad and sorted(rows_of(after)) == sorted(r for r in given if r[0] not in bad)
    given, after = seen["exact_dedup"]
    least = {}
    for i, t, *_ in given:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        least[t] = min(least.get(t, i), i)
    assert sorted(r[0] for r in rows_of(after)) == sorted(least.values()) and len(least) < len(given)
    given, after = seen["simhash_near_dedup"]
    # The stage links documents whose five-word shingle sets are 0.8 alike or more.
    sets = {i: five_words(t) for i, t, *_ in given}
    pairs = [(a, b) for a in sets for b in sets if a < b
             and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = find_all(pairs, list(sets))
    assert sorted(r[0] for r in rows_of(after)) == sorted(set(root.values()))
    given, after = seen["source_mix"]
    words = lambda t: len(t.split())
    sizes = {}
    for _, t, _, s in given:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = brute_targets(sizes), {}
    for i, t, _, s in rows_of(after):
        taken[s] = taken.get(s, 0) + words(t)
        assert any(g[0] == i and g[1] == t for g in given)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.15)
    given, after = seen["packing"]
    check_pieces(after.collect(), given, Tokenizer.from_file(default_tokenizer()))


def test_run_and_registration(spark):
    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_edges(spark):
    for given, least in ((edges(spark), 1), (empty(spark), 0)):
        docs = materialize(given, "edge-docs")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, materialize(stage(spark, docs, SF), "edge-stage")
            if name != "packing":
                assert docs.columns == before.columns
        assert docs.count() >= least
    assert len(EDGES) > 10
