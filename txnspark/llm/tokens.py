"""Token ids of whole texts by a byte-level BPE tokenizer, with a cache of words.

A byte-level BPE tokenizer splits a text into pieces before it merges, and a word after
a single space is a piece of its own. So the ids of a text are the ids of its words joined.
A batch of texts is split and numbered by its different words in Arrow. Those of letters only
are tokenised together, the ids of the others come from a cache of the worker, and numpy puts
them together. Texts where that does not hold (several white-space characters in a row, control strings) go to the
tokenizer as a whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from txnspark.llm.common import worker_state

# Fixed values of the public byte-level BPE: its split pattern and its printable bytes.
SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))

CACHE_WORDS = 120_000
BATCH_BYTES = 4 << 20  # texts numbered together, bounds memory
# Stand before a word that follows no space: at the start, after a newline, or a mark behind
# the letters it ends.
START, NEWLINE, MARK = "\x01", "\x00", "\x02"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """word -> little-endian 32-bit ids, or None; keeps the words seen lately, in two
    generations."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(self, word)  # may add parts of the word
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class TextTokenizer:
    """``ids(text)``: the ids the tokenizer file gives, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.loaded = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = {chr(b): b for b in PLAIN_BYTES}
        for n, b in enumerate(b for b in range(256) if b not in PLAIN_BYTES):
            letters[chr(256 + n)] = b
        ranks = {bytes(letters[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        # The same vocabulary and merges, faster on single words.
        self.single = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks,
                                        special_tokens={})
        self.size = max(ranks.values()) + 1 + len(special)
        self.marks = [m for m in special if m]
        self.merge = self.single._core_bpe.encode_single_piece
        self.newline = self._pack("\n")
        self.after_space = np.zeros(self.size, dtype=bool)
        self.after_space[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.words = _Words(self._word)

    def _pack(self, text: str) -> bytes:
        return _bytes(self.single.encode_ordinary(text))

    def _piece(self, text: str) -> bytes:
        """Ids of a text that is one piece: merges only, nothing to split."""
        return _bytes(self.merge(text.encode()))

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, each after a space, and where those of each start: they
        are one text, in which only an id that starts with a space starts a word."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        together = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        text = " " + pc.binary_join(together, " ")[0].as_py()
        ids = np.array(self.single._core_bpe.encode_ordinary(text), dtype="<u4")
        starts = np.flatnonzero(self.after_space[ids])
        if len(starts) != len(words):
            raise ValueError("words of letters were not told apart")
        return ids, starts

    def _word(self, words: _Words, word: str) -> bytes | None:
        """Ids of a word with what stands before it; None if a text with it must go whole."""
        lead = word[:1]
        follows = lead in (START, NEWLINE, MARK)
        if follows:
            word = word[1:]
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if lead == NEWLINE:
            rest = words[START + word]
            return None if rest is None else self.newline + rest
        text = word if follows else " " + word
        return self._piece(text) if word.isalpha() else self._pack(text)

    def _whole(self, text: str) -> bytes:
        if self.loaded is None:  # few texts need it, and it is large
            from tokenizers import Tokenizer
            self.loaded = Tokenizer.from_file(self.path)
        return _bytes(self.loaded.encode(text, add_special_tokens=False).ids)

    def _numbered(self, texts: pa.Array):
        """Ids of the different words; per different word where its ids start and their number;
        the word numbers of all texts; where each text's words start; which texts must go whole."""
        odd = pc.match_substring_regex(texts, f"[{START}{NEWLINE}{MARK}]|^ |^$")
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        marked = pc.binary_join_element_wise(
            START, pc.replace_substring(texts, "\n", " " + NEWLINE), "")
        # Letters and one mark behind them are two pieces.
        marked = pc.replace_substring_regex(
            marked, r"(\pL)([.,])( |$)", f"\\1 {MARK}\\2\\3")
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy()
        starts = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        whole = odd.to_numpy(zero_copy_only=False)
        different = coded.dictionary
        letters = pc.utf8_is_alpha(different)
        of_letters, at = self._letters(different.filter(letters))
        letters = letters.to_numpy(zero_copy_only=False)
        # By numpy, because Arrow makes its strings one by one.
        others = different.filter(pa.array(~letters)).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.__getitem__, others))
        if None in ids:
            bad = np.zeros(len(different), dtype=np.int64)
            bad[~letters] = [x is None for x in ids]
            whole = whole | (np.add.reduceat(bad[numbers], starts) > 0)
            ids = [x or b"" for x in ids]
        first, sizes = np.empty((2, len(different)), dtype=np.int64)
        first[letters], sizes[letters] = at, np.diff(at, append=len(of_letters))
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first[~letters] = len(of_letters) + np.cumsum(lengths) - lengths
        sizes[~letters] = lengths
        table = np.concatenate([of_letters, np.frombuffer(b"".join(ids), dtype="<u4")])
        return table, first, sizes, numbers, starts, whole

    def _stretches(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The texts in order, a few megabytes at a time."""
        if not len(texts):
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
            yield texts.slice(at, to - at)
            at = to

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for part in self._stretches(texts):
            table, first, sizes, numbers, starts, whole = self._numbered(part)
            lengths = sizes[numbers]
            ends = np.cumsum(lengths)
            places = np.repeat(first[numbers] - (ends - lengths), lengths)
            places += np.arange(len(places))
            flat = table[places]
            bounds = np.append((ends - lengths)[starts], len(flat))
            for i in range(len(part)):
                if whole[i]:
                    yield np.frombuffer(self._whole(part[i].as_py()), dtype="<u4")
                else:
                    yield flat[bounds[i]:bounds[i + 1]]

    def counts(self, texts: pa.Array) -> Iterator[int]:
        """The number of ids of each text."""
        for part in self._stretches(texts):
            _, _, sizes, numbers, starts, whole = self._numbered(part)
            for i, n in enumerate(np.add.reduceat(sizes[numbers], starts).tolist()):
                yield len(self._whole(part[i].as_py())) // 4 if whole[i] else n

    def ids(self, text: str) -> np.ndarray:
        return next(self.each(pa.array([text], pa.string())))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Per id: whether it ends a sentence for sure, and whether it does before a space.

        Second table: whether an id starts with white space.
        """
        final = np.zeros(self.size, dtype=np.int8)
        space = np.zeros(self.size, dtype=bool)
        for i in range(self.size):
            try:
                raw = self.single.decode_single_token_bytes(i)
            except KeyError:
                continue
            final[i] = 2 if b"\n" in raw else int(raw.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?"))
            space[i] = raw[:1].isspace()
        return final, space


def tokenizer(path: str) -> TextTokenizer:
    """One per worker process, kept over tasks."""
    held = worker_state()
    if path not in held:
        held[path] = TextTokenizer(path)
    return held[path]
