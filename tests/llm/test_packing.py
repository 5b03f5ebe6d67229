import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES, documents, edges, empty, sample
from tokenizers import Tokenizer

from txnspark.llm import tokens
from txnspark.llm.packing import WINDOW, best_cuts, pack
from txnspark.llm.tokens import TextTokenizer, default_tokenizer


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_tokenizer())


ODD = ["", " ", "a", " a", "a ", "a b", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "it's we'll I'd",
       "x.\nThe", "\0 a \0", "a\0b", "tab\tin", "<|endoftext|>", "a <|endoftext|> b", "é è ü",
       " x y", "1,234.5 67%", "don't. 'Tis!", "word, word. word! word?", "\x85 a\x1cb",
       "日本語 テキスト", "\U0001f600 a", "a\r\nb", "..,, a,.b", "O'Neil's", "A1b2 c3."]


def test_ids_equal_the_tokenizer(whole, spark, monkeypatch):
    tok = TextTokenizer(default_tokenizer())
    texts = ODD + [t for _, t, _, _ in EDGES if t] + [
        r["text"] for r in sample(spark, 300).select("text").collect()]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip([*texts, *texts[:40]], [*want, *want[:40]]):
        assert tok.ids(t).tolist() == ids, repr(t[:60])
    together = pa.array(texts, pa.string())
    assert [x.tolist() for x in tok.each(together)] == want
    assert list(tok.counts(together)) == [len(x) for x in want]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 2000)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    tok = TextTokenizer(default_tokenizer())
    assert [x.tolist() for x in tok.each(together.slice(5, 200))] == want[5:205]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    window, cuts = 128, np.concatenate([[0], np.cumsum(rng.integers(1, 60, 11))])
    penalty = np.where(np.arange(12) == 11, 0, rng.integers(0, 30, 12)).astype(float)

    def price(chosen):
        total = 0
        for a, b in zip(chosen, chosen[1:]):
            n = cuts[b] - cuts[a]
            if n > window:
                return 1e9
            total += (0 if n & (n - 1) == 0 and n >= 64 else window - n) + penalty[b]
        return total
    best = min(price((0, *mid, 11)) for k in range(11)
               for mid in itertools.combinations(range(1, 11), k))
    assert price(best_cuts(cuts, penalty, window).tolist()) == best


def check(rows, given, whole):
    want = {}
    for doc_id, text, *_ in given:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc_id, []).append(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = want[r["doc_id"]]
        assert any(r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(
            x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for x in ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= WINDOW
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
    for doc_id, lists in want.items():
        assert sorted(covered[doc_id]) == sorted(i for x in lists for i in range(len(x)))
    return {k: max(o + n for o, n in v) for k, v in sequences.items()}


def test_pieces_cover_every_id_once(spark, whole):
    given = sample(spark)
    rows = pack(given).collect()
    sizes = check(rows, given.collect(), whole)
    pad = sum(0 if n & (n - 1) == 0 else WINDOW - n for n in sizes.values())
    assert pad < 0.02 * sum(sizes.values()) + WINDOW * given.rdd.getNumPartitions()


def test_edges(spark, whole):
    check(pack(edges(spark)).collect(), EDGES, whole)
    assert pack(empty(spark)).collect() == []


def test_a_long_stream_is_cut_in_bounded_stretches(spark, whole, monkeypatch):
    from txnspark.llm import packing
    monkeypatch.setattr(packing, "STREAM_TOKENS", 30_000)
    stream = packing._Stream(default_tokenizer(), WINDOW, 1, 5)
    given = [(i, t, None, None) for i, t in enumerate(
        [r["text"] for r in sample(spark, 120).select("text").collect()] + [EDGES[4][1]])]
    rows = [p for i, t, *_ in given for p in stream.add(i, stream.tok.ids(t or ""))] + list(stream.cut(last=True))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check([dict(zip(names, r)) for r in rows], given, whole)


def test_words_of_letters_are_tokenised_together(whole, monkeypatch):
    tok, alone = TextTokenizer(default_tokenizer()), []
    monkeypatch.setattr(tok, "merge", lambda word: alone.append(word) or tok.single._core_bpe
                        .encode_single_piece(word))
    texts = ["Zuerst qwlorp vembit, then 12 flurbs. Ünd 日本語 ʰx zz",
             "start qwlorp x1y don't", "", "only"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tok.each(pa.array(texts))] == want
    assert list(tok.counts(pa.array(texts))) == [len(x) for x in want]
    # Only the first word of a text, which follows no space, is merged by itself.
    assert sorted(alone) == [b"Zuerst", b"only", b"start"]
