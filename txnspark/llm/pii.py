"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans. The chain adds spans the patterns miss (a phone number
without a plus sign, a card number grouped by dots, ...). Its states are O and the four
kinds. Only a word with a digit or an @ can have a kind (a hard constraint of the model),
so the chain falls apart exactly at all other words, and Viterbi runs over short runs of
such words; their neighbours enter as features. All runs of one length in an Arrow batch
are decoded together in numpy.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import row_key, text_of
from txnspark.llm.pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *KINDS)
BUCKETS = 1 << 12
TRAIN_DOCUMENTS = 2000  # rows of the table, besides the examples, the chain is fitted on
TRAIN_RUNS = 20  # runs of one such row
MARGIN = 2.0  # log-odds a path with a span must have over the path without any
OWN_WEIGHT = 4.0

_SPACES = " \t\n\x0b\x0c\r"
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits that fails from its first digit fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and a domain with a dot; linear in the text.

    A match holds one @ behind it all characters a local part may have, so each @ is
    looked at once: back to the first such character, then on over the domain.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of all pattern matches, in order."""
    if not _MARK.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits with 18 separators
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(1 for _ in _DIGIT.finditer(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _word_end(text: str, at: int) -> int:
    m = _SPACE.search(text, at)
    return m.start() if m else len(text)


def _word_before(text: str, at: int) -> tuple[int, int]:
    end = at
    while end and text[end - 1] in _SPACES:
        end -= 1
    start = end
    while start and text[start - 1] not in _SPACES and end - start < 24:
        start -= 1
    return start, end


def candidate_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an @, as (start, end) each."""
    run: list[tuple[int, int]] = []
    m = _MARK.search(text)
    while m:
        start, floor = m.start(), run[-1][1] if run else 0
        while start > floor and text[start - 1] not in _SPACES:
            start -= 1
        end = _word_end(text, m.end())
        if run and text[run[-1][1]:start].strip(_SPACES):
            yield run
            run = []
        run.append((start, end))
        m = _MARK.search(text, end)
    if run:
        yield run


def _size(n: int) -> str:
    for low, name in ((20, "20"), (16, "16"), (12, "12"), (10, "10"), (7, "7"), (5, "5")):
        if n >= low:
            return name
    return str(n)


def _shapes(word: str) -> tuple[str, str]:
    """Shape with run lengths, and without."""
    long, short, last, n = [], [], "", 0
    for c in word[:64] + "\0":
        k = ("9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper()
             else "x" if c.isalpha() else c)
        if k == last:
            n += 1
            continue
        if last:
            long.append(last + _size(n))
            short.append(last)
        last, n = k, 1
    return "".join(long), "".join(short)


def _features(word: str, before: str, after: str) -> list[int]:
    digits, (long, short) = _digits(word[:64]), _shapes(word)
    core = word.strip("\"'.,;:!?()[]<>")
    names = ["bias", f"s={long}", f"c={short}", f"n={_size(len(digits))}",
             f"b={before.lower().strip(':.,')}", f"bs={_shapes(before)[1][-6:]}",
             f"a={_shapes(after)[1][:6]}", f"at={core.count('@')}", f"dots={core.count('.')}",
             f"t={long[-6:]}", f"dash={core.count('-')}"]
    if 12 <= len(digits) <= 19:
        names.append(f"luhn={_luhn(digits)}")
    if any(c.isalpha() for c in core):
        names.append(f"letters={'@' in core}")
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def _run_features(text: str, run: list[tuple[int, int]]) -> list[list[int]]:
    words = [text[a:b] for a, b in run]
    a, b = _word_before(text, run[0][0])
    first = text[a:b]
    at = run[-1][1]
    while at < len(text) and text[at] in _SPACES:
        at += 1
    last = text[at:min(_word_end(text, at), at + 24)]
    around = [first, *words, last]
    return [_features(w[:256], around[i][-24:], around[i + 2][:24])
            for i, w in enumerate(words)]


def _emissions(weights: np.ndarray, runs: list[list[list[int]]]) -> np.ndarray:
    """(runs, length, states) for runs of one length."""
    flat = [f for run in runs for f in run]
    starts = np.cumsum([0] + [len(f) for f in flat[:-1]])
    ids = np.fromiter((i for f in flat for i in f), dtype=np.int64)
    return np.add.reduceat(weights[ids], starts, axis=0).reshape(len(runs), -1, len(STATES))


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def fit(runs: list[tuple[list[list[int]], list[int], float]], rounds: int = 120,
        rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, states) and transitions of the chain, by likelihood.

    ``runs``: (features of each word, states, weight). Forward-backward gives the
    gradient; Adam steps with a little weight decay.
    """
    k = len(STATES)
    params = [np.zeros((BUCKETS, k)), np.zeros((k, k))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    groups = defaultdict(list)
    for run in runs:
        groups[len(run[1])].append(run)
    total = sum(r[2] for r in runs) or 1.0
    for step in range(1, rounds + 1):
        grads = [decay * p for p in params]
        for length, rows in groups.items():
            e = _emissions(params[0], [r[0] for r in rows])
            gold, fee = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]) / total
            n, trans = len(rows), params[1]
            ahead, behind = np.zeros((n, length, k)), np.zeros((n, length, k))
            ahead[:, 0] = e[:, 0]
            for t in range(1, length):
                ahead[:, t] = e[:, t] + _logsum(ahead[:, t - 1][:, :, None] + trans, 1)
            for t in range(length - 2, -1, -1):
                behind[:, t] = _logsum(trans + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            norm = _logsum(ahead[:, -1], 1)
            off = np.exp(ahead + behind - norm[:, None, None])
            off[np.arange(n)[:, None], np.arange(length)[None, :], gold] -= 1
            off *= fee[:, None, None]
            words = [(f, off[i, t]) for i, r in enumerate(rows) for t, f in enumerate(r[0])]
            ids = np.concatenate([f for f, _ in words])
            np.add.at(grads[0], ids, np.repeat(np.array([g for _, g in words]),
                                               [len(f) for f, _ in words], axis=0))
            for t in range(1, length):
                both = np.exp(ahead[:, t - 1][:, :, None] + trans
                              + (e[:, t] + behind[:, t])[:, None, :] - norm[:, None, None])
                both[np.arange(n), gold[:, t - 1], gold[:, t]] -= 1
                grads[1] += (both * fee[:, None, None]).sum(axis=0)
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[0].astype(np.float32), params[1].astype(np.float32)


def viterbi(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best states (runs, length), and how far the best path is above the one all O."""
    n, length, k = e.shape
    score, back = e[:, 0].astype(np.float64), np.zeros((n, length, k), dtype=np.int8)
    for t in range(1, length):
        step = score[:, :, None] + trans
        back[:, t] = step.argmax(axis=1)
        score = e[:, t] + step.max(axis=1)
    states = np.zeros((n, length), dtype=np.int8)
    states[:, -1] = score.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        states[:, t - 1] = back[np.arange(n), t, states[:, t]]
    none = e[:, :, 0].sum(axis=1) + trans[0, 0] * (length - 1)
    return states, score.max(axis=1) - none


_TRIM = "\"'.,;:!?()[]<>{}|#*$%&="


def _plausible(kind: int, word: str) -> bool:
    digits = len(_digits(word))
    if kind == 0:
        name, at, host = word.rpartition("@")
        return bool(name) and "." in host.strip(".") and at == "@"
    if kind == 1:
        parts = re.findall(r"[0-9]+", word)
        return len(parts) >= 4 and all(len(p) < 4 and int(p) <= 255 for p in parts[:4])
    if kind == 2:
        return 12 <= digits <= 19 and _luhn(_digits(word))
    return 7 <= digits <= 15 and not any(c.isalpha() for c in word)


def _labelled(text: str, spans: list[tuple[int, int, int]], weight: float,
              checked: bool = True) -> list:
    """Training runs of a text whose spans are (start, kind number, end).

    Unless the text was ``checked`` by hand, a run without a span that could be personal data
    all the same teaches nothing and is left out.
    """
    out = []
    for run in candidate_runs(text):
        states = []
        for a, b in run:
            kinds = [k + 1 for s, k, e in spans if s < b and a < e]
            states.append(kinds[0] if kinds else 0)
        parts = [text[run[0][0]:run[-1][1]], *[text[a:b] for a, b in run]]
        if not checked and not any(states) and any(
                _plausible(k, p.strip(_TRIM)) for k in range(4) for p in parts):
            continue
        out.append((_run_features(text, run), states, weight))
    return out


def _example_runs() -> list:
    out = []
    for kind, text, part in EXAMPLES:
        at = text.find(part) if part else -1
        spans = [(at, KINDS.index(kind), at + len(part))] if part else []
        out += _labelled(text, spans, OWN_WEIGHT)
    return out


def train(docs: DataFrame, text: str = "text",
          documents: int = TRAIN_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Fits the chain on the labelled examples and a bounded sample of ``docs``.

    Of the rows with a digit or an @, the ``documents`` with the least hash give up to
    20 stretches each, labelled by the patterns.
    """
    marked = docs.select(row_key(docs).alias("_row"), text_of(text).alias("_body")).where(
        F.col("_body").rlike("[0-9@]"))
    chosen = marked.select("_row").distinct().orderBy(F.xxhash64("_row"), "_row").limit(documents)
    # At most ``documents`` hashes.
    parts = F.slice(F.regexp_extract_all(
        "_body", F.lit(r"(?s).{0,48}[0-9@].{0,80}"), F.lit(0)), 1, TRAIN_RUNS)
    sample = (marked.join(F.broadcast(chosen), "_row", "left_semi")
              .select(F.explode(F.array_distinct(parts)).alias("part"))
              .groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.xxhash64("part"), "part").limit(documents * 2).collect())
    runs = _example_runs()
    for row in sample:
        runs += _labelled(row["part"], base_spans(row["part"]), 1.0, checked=False)
    return fit(runs)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
          "base_sha256 string, spans string")
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string())
                    for c in SCHEMA.split(", ")])


def find_personal_data(docs: DataFrame, text: str = "text",
                       documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts per kind, base_sha256 and spans.

    Base spans are pattern matches; the chain adds words it labels in a path well above
    the path without any label, if they pass a plausibility check and touch no base span.
    Spans are kind:start:end in code points, end exclusive, by start, then kind.

    A null text counts as empty: no spans, and the hash of nothing. Whole texts are read,
    in time linear in their length. Repeated rows get a row each. Other columns are not
    read, except that they tell rows apart for the training sample. An empty table
    gives an empty result.
    """
    weights, trans = train(docs, text, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            base, groups = [], defaultdict(list)
            for row, body in enumerate(texts):
                base.append(base_spans(body))
                for words in candidate_runs(body):
                    groups[len(words)].append((row, words, _run_features(body, words)))
            added = defaultdict(list)
            for length, found in groups.items():
                states, margin = viterbi(_emissions(weights, [f[2] for f in found]), trans)
                for i in np.flatnonzero(margin >= MARGIN):
                    row, words, _ = found[i]
                    added[row] += _added(texts[row], words, states[i].tolist(), base[row])
            columns = [[], [], [], [], [], []]
            for row, spans in enumerate(base):
                kinds = [s[1] for s in spans]
                for k in range(4):
                    columns[k].append(kinds.count(k))
                columns[4].append(hashlib.sha256(_joined(spans).encode()).hexdigest())
                columns[5].append(_joined(sorted({*spans, *added[row]})))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip([ids, *columns], _ARROW)],
                schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInArrow(
        run, SCHEMA)


def _added(text: str, words: list[tuple[int, int]], states: list[int],
           base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of equal neighbouring states, trimmed, checked, and clear of the base spans."""
    out, i = [], 0
    while i < len(words):
        j = i
        while j + 1 < len(words) and states[j + 1] == states[i]:
            j += 1
        if states[i]:
            a, b = words[i][0], words[j][1]
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            kind = states[i] - 1
            if a < b and b - a <= 320 and _plausible(kind, text[a:b]) and not any(
                    s < b and a < e for s, _, e in base):
                out.append((a, kind, b))
        i = j + 1
    return out
