import os
import zlib

import numpy as np
import pytest
from helpers import EDGES, edges, empty, sample
from tokenizers import Tokenizer

from txnspark.llm.token_shards import permute, read_slots, write_shards
from txnspark.llm.tokens import default_tokenizer


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 65_537])
def test_permutation_is_a_bijection_with_an_inverse(n):
    out = permute(np.arange(n), n, key=99)
    assert sorted(out.tolist()) == list(range(n))
    assert permute(out, n, key=99, inverse=True).tolist() == list(range(n))
    if n > 60:
        assert (out != permute(np.arange(n), n, key=98)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.2


def check(manifest, root, given, length=64):
    rows = sorted(manifest.collect())
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    whole = Tokenizer.from_file(default_tokenizer())
    want = {}
    for doc_id, text, *_ in given:
        want.setdefault(doc_id, []).append(
            [*whole.encode(text or "", add_special_tokens=False).ids, 1])
    read = read_slots(root, 0, len(rows))
    assert read.shape == (len(rows), length)
    for r, ids in zip(rows, read):
        assert r["byte_offset"] == r["slot"] % 512 * length * 2 and r["shard"] == r["slot"] // 512
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
    # In the order before the permutation the stream of each scan task comes back.
    place = permute(np.arange(len(rows)), len(rows))
    stream = []
    for slot in place:
        stream += read[slot][:rows[slot]["n_ids"]].tolist()
    tokens = [i for lists in want.values() for x in lists for i in x]
    assert len(stream) == len(tokens) and sorted(stream) == sorted(tokens)
    order = [d for slot in place for d in rows[slot]["doc_ids"]]
    seen = list(dict.fromkeys(order))
    assert set(seen) == set(want)
    return stream, seen, want


def test_shards_hold_every_id_in_permuted_order(spark, path):
    given = sample(spark).coalesce(1)
    manifest, root = write_shards(given, path, length=64)
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    stream, seen, want = check(manifest, root, rows)
    assert stream == [i for d in seen for x in want[d] for i in x]
    assert len([f for f in os.listdir(root) if f.endswith(".bin")]) == -(-manifest.count() // 512)
    # Reading on from any slot gives the same sequences.
    all_ids = read_slots(root, 0, 10 ** 9)
    assert (read_slots(root, 500, 40) == all_ids[500:540]).all()


def test_edges(spark, path):
    check(*write_shards(edges(spark), path, length=64), EDGES)


def test_an_empty_table(spark, path):
    manifest, root = write_shards(empty(spark), path)
    assert manifest.collect() == [] and read_slots(root, 0, 5).shape == (0, 2048)
