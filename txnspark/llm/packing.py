"""Packing token streams into fixed windows by dynamic programming.

Order is preserved: the documents of a scan partition form one stream of ids, and
sequences are consecutive windows of it. The windows are cut at document or sentence ends
so that padding plus truncation penalties are least. With P the tokens before a cut,

    cost(j) = min over cuts i, P[j] - P[i] <= window, of cost(i) + pad(P[j] - P[i]) + penalty(j)

and pad(n) = window - n, so the minimum over i of cost(i) - (window's start) slides with j:
a monotone queue holds the candidates and gives each transition in constant time. Lengths
that need no padding (powers of two) are looked up beside it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import text_of
from txnspark.llm.tokens import default_tokenizer, tokenizer

WINDOW = 2048
END_ID = 1
STREAM_TOKENS = 1 << 20  # ids held and cut at a time
SENTENCE_PENALTY = 2.0  # in padding tokens: a cut between sentences of one document
CUT_PENALTY = 48.0  # a cut inside a sentence
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indices into ``cuts`` where windows begin and end, at least total cost.

    ``cuts``: increasing token positions, the first 0, neighbours at most ``window`` apart;
    ``penalty``: cost of each cut. Padding counts one per token, none for a window whose
    length is a power of two.
    """
    at, fee = cuts.tolist(), penalty.tolist()
    n = len(at)
    index = {p: i for i, p in enumerate(at)}
    free = [1 << k for k in range(6, window.bit_length()) if 1 << k < window]
    cost, back = [0.0] * n, [0] * n
    # Candidates with growing cost(i) + P[i]; the first is the best in reach.
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    find = index.get
    for j in range(1, n):
        here = at[j]
        reach = here - window
        while at[queue[0][1]] < reach:
            queue.popleft()
        value, i = queue[0]
        best = value + window - here
        for size in free:
            k = find(here - size)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += fee[j]
        cost[j], back[j] = best, i
        value = best + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    ends, j = [n - 1], n - 1
    while j:
        j = back[j]
        ends.append(j)
    return np.array(ends[::-1])


def _cut_places(ids: np.ndarray, doc_ends: np.ndarray, final: np.ndarray, space: np.ndarray,
                window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of each."""
    total = len(ids)
    mark = final[ids]
    after_space = np.ones(total, dtype=bool)
    after_space[:-1] = space[ids[1:]]
    sentence = np.flatnonzero((mark == 2) | ((mark == 1) & after_space)) + 1
    # Everywhere a long stretch has no such end, a few places inside it.
    stops = np.union1d(sentence, doc_ends)
    edges = np.concatenate([[0], stops, [total]])
    gaps = np.flatnonzero(np.diff(edges) > window // 8)
    inner = [np.arange(edges[g] + window // 8, edges[g + 1], window // 8) for g in gaps]
    cuts = np.unique(np.concatenate([[0], stops, [total], *inner]).astype(np.int64))
    penalty = np.full(len(cuts), CUT_PENALTY)
    penalty[np.searchsorted(cuts, sentence)] = SENTENCE_PENALTY
    penalty[np.searchsorted(cuts, doc_ends)] = 0.0
    penalty[-1] = 0.0
    return cuts, penalty


class _Stream:
    """Cuts one partition's stream of documents, a bounded stretch at a time."""

    def __init__(self, path: str, window: int, end_id: int, first_sequence: int):
        self.tok, self.window, self.end = tokenizer(path), window, end_id
        held = self.tok.__dict__
        if "tables" not in held:
            held["tables"] = self.tok.ends()
        self.final, self.space = held["tables"]
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []  # ids not cut yet
        self.docs: list[tuple] = []  # (doc_id, tokens, start of the part held)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Takes in a document (its ids without the end id); pieces that are settled."""
        ids = np.append(ids, np.uint32(self.end)).astype("<u4")
        for start in range(0, len(ids), STREAM_TOKENS):
            part = ids[start:start + STREAM_TOKENS]
            self.parts.append(part)
            self.docs.append((doc_id, len(ids), start, start + len(part) == len(ids)))
            self.held += len(part)
            if self.held >= STREAM_TOKENS:
                yield from self.cut(last=False)

    def cut(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        ends = np.cumsum([len(p) for p in self.parts])
        done = ends[[d[3] for d in self.docs]]
        cuts, penalty = _cut_places(ids, done, self.final, self.space, self.window)
        chosen = cuts[best_cuts(cuts, penalty, self.window)]
        if not last and len(chosen) > 9:
            chosen = chosen[:-8]  # the last windows are cut again with what follows
        keep = int(chosen[-1])
        begins = np.concatenate([[0], ends[:-1]])
        doc = 0
        for a, b in zip(chosen[:-1].tolist(), chosen[1:].tolist()):
            at = a
            while at < b:
                while ends[doc] <= at:
                    doc += 1
                upto = min(b, int(ends[doc]))
                doc_id, tokens, start, _ = self.docs[doc]
                yield (doc_id, start + at - int(begins[doc]), upto - at,
                       zlib.crc32(ids[at:upto].tobytes()), tokens, self.sequence, at - a)
                at = upto
            self.sequence += 1
        # What is left, with its documents.
        parts, docs = [], []
        for (doc_id, tokens, start, whole), begin, end in zip(self.docs, begins.tolist(),
                                                             ends.tolist()):
            if end > keep:
                skip = max(0, keep - begin)
                parts.append(ids[begin + skip:end])
                docs.append((doc_id, tokens, start + skip, whole))
        self.parts, self.docs, self.held = parts, docs, len(ids) - keep


def pack(docs: DataFrame, text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer_path: str | None = None) -> DataFrame:
    """Packs all documents, in the order of the scan, into sequences of ``window`` ids or fewer.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens (with the end id), sequence_id, offset in the sequence. Every id lies in
    one piece. Nothing is shuffled: a task packs the documents of its scan partition, so
    sequence ids are unique but not gapless over tasks, and a partition wastes one
    window at most. Memory holds about a million ids besides one batch of texts.

    A null or empty text is its end id alone. A text longer than a window is cut between
    sentences, or each eighth of a window where none ends. Repeated rows are packed each.
    Other columns are not read. An empty table gives an empty result.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows = None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(_ARROW)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in columns], schema=_ARROW)

        for batch in batches:
            if stream is None and batch.num_rows:
                stream = _Stream(path, window, end_id, batch.column(2)[0].as_py() << 33)
            if stream is not None:
                for doc_id, ids in zip(batch.column(0).to_pylist(),
                                       stream.tok.each(batch.column(1))):
                    rows.extend(stream.add(doc_id, ids))
            if len(rows) > 50_000:
                yield out()
        if stream is not None:
            rows.extend(stream.cut(last=True))
        yield out()

    given = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text"),
                        F.spark_partition_id().alias("part"))
    return given.mapInArrow(run, SCHEMA)
