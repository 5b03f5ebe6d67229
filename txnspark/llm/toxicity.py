"""Toxicity by class-conditional Kneser-Ney models of word spelling.

Both classes have a model of the bytes of lower-cased words: each byte is predicted from up to
six before it in the same word, the space before the word included, so a word's probability is
the product over its bytes and inflected or misspelt forms share the counts of their stem. A
class's own counts are discounted by ``CLASS_DISCOUNT`` and what that frees goes to an
interpolated Kneser-Ney model of both classes together. Rare expressions thus have equal
probability in both classes and say nothing. A text scores the mean over its words of the log
likelihood ratio, toxic against ordinary, as far as it exceeds ``MARGIN``.

The counts are Spark tables over all labelled rows and grow with them. Only grams that some
class has more than ``CLASS_DISCOUNT`` times, and their contexts, tell the classes apart; that
small table is sent to the workers while it has ``LOCAL_GRAMS`` rows or fewer, and joined beyond.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import text_of
from txnspark.session import materialize

ORDER = 7                # bytes of a gram: six of context and the one predicted
CLASS_DISCOUNT = 4.0
POOLED_DISCOUNT = 0.75
MARGIN = 1.5             # nats a word must exceed to count
HELD_OUT = 1             # the remainder of crc32(doc_id) modulo 3 that is never learned from
CALIBRATION = 6          # one in so many labelled rows sets the threshold instead of counting
THRESHOLD = 0.7
LOCAL_GRAMS = 6_000_000
CACHED_WORDS = 150_000
TEXTS_AT_ONCE = 64
_LEAST = 0.002           # added to a mean before its logarithm
_USUAL = math.log(0.05)  # where the calibration starts from: odds are even at this mean


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, word number) of each byte predicted, word ends included.

    A gram is its length in bits 56 and up, over its bytes with the predicted one lowest.
    Words have no spaces, so a gram with a space first starts at the start of a word.
    """
    a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    spaces = np.flatnonzero(a == 32)
    owner = np.repeat(np.arange(len(words)), np.diff(spaces))
    at = np.arange(1, len(a))
    into = at - spaces[owner]
    body = np.zeros(len(at), dtype=np.int64)
    for back in range(ORDER - 1, -1, -1):
        body = (body << 8) | np.where(into >= back, a[at - back], 0)
    return body | (np.minimum(into + 1, ORDER) << 56), owner


def _length(gram: Column) -> Column:
    return F.shiftright(gram, 56)


def _body(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit((1 << 56) - 1))


def _key(length: Column, body: Column) -> Column:
    return body.bitwiseOR(F.shiftleft(length.cast("long"), 56))


def context_of(gram: Column) -> Column:
    """A gram without the byte it predicts."""
    return _key(_length(gram) - 1, F.shiftright(_body(gram), 8))


def suffix_of(gram: Column, length) -> Column:
    """The last ``length`` bytes of a gram."""
    bits = (F.lit(8) * length).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return _key(length, _body(gram).bitwiseAND(mask))


def _starts(gram: Column) -> Column:
    """Whether a gram starts at the start of a word; a single space is the end of one."""
    shift = ((_length(gram) - 1) * 8).cast("int")
    return (_length(gram) > 1) & (F.call_function("shiftright", _body(gram), shift) == 32)


_COUNTS = pa.schema([("gram", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a task's labelled texts; its words are counted first, a bounded number at once."""
    seen, held = (Counter(), Counter()), 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for mark in (0, 1):
            if seen[mark]:
                gram, owner = grams_of(list(seen[mark]))
                keys.append(gram)
                n = np.zeros((len(gram), 2), dtype=np.int64)
                n[:, mark] = np.fromiter(seen[mark].values(), np.int64)[owner]
                counts.append(n)
                seen[mark].clear()
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(n, first, axis=0)
        for i in range(0, len(first), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first[s]]), pa.array(total[s, 0]), pa.array(total[s, 1])],
                schema=_COUNTS)

    for batch in batches:
        for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_py().lower().encode("utf-8", "surrogatepass")
            seen[mark].update(raw.split())
            held += len(raw)
            if held > 16_000_000:
                yield from flush()
                held = 0
    yield from flush()


def _remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def held_out(doc_id: Column) -> Column:
    return _remainder(doc_id, 3) == HELD_OUT


def _marks(labels: DataFrame) -> DataFrame:
    """(_doc, toxic, calibrates), one row per labelled document that may be learned from."""
    doc = F.col("doc_id")
    found = labels.where(F.col("toxic").isin(0, 1) & doc.isNotNull() & ~held_out(doc))
    return materialize(found.groupBy(doc.alias("_doc")).agg(F.max("toxic").alias("toxic"))
                       .withColumn("calibrates", F.pmod(F.xxhash64("_doc"), F.lit(CALIBRATION)) == 0),
                       "marks")


def class_counts(docs: DataFrame, marks: DataFrame, text: str = "text") -> DataFrame:
    """(gram, c0, c1) of all counted rows: every labelled row outside both held-out parts."""
    rows = (docs.where(~held_out(F.col("doc_id")))
            .select("doc_id", text_of(text).alias("text"))
            .join(marks.where(~F.col("calibrates")), F.col("doc_id") == F.col("_doc"))
            .select("text", F.col("toxic").cast("int").alias("toxic")))
    return rows.mapInArrow(_count, "gram long, c0 long, c1 long").groupBy("gram").agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def pooled(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probability, both classes together, of ``wanted``.

    Grams that start a word or have full length keep their counts; all others count the
    different bytes seen before them.
    """
    gram = F.col("gram")
    # All types of all lengths; the top ones are counted, the others only listed.
    lower = counts.select(F.explode(F.transform(
        F.sequence(F.lit(1), _length(gram) - 1), lambda k: suffix_of(gram, k.cast("long"))))
        .alias("gram"))
    types = materialize(counts.select("gram").union(lower).distinct(), "gram-types")
    follow = types.where(_length(gram) > 1).groupBy(
        suffix_of(gram, _length(gram) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    n = materialize(
        counts.select("gram", (F.col("c0") + F.col("c1")).alias("n")).union(
            follow.where((_length(gram) < ORDER) & ~_starts(gram))), "gram-counts")
    contexts = materialize(n.groupBy(context_of(gram).alias("_context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("followers")), "gram-contexts")
    chain = wanted.select("gram", F.explode(F.sequence(F.lit(1), _length(gram))).alias("k"))
    chain = chain.withColumn("_gram", suffix_of(gram, F.col("k").cast("long")))
    steps = (chain.join(n.withColumnRenamed("gram", "_n_gram"), F.col("_gram") == F.col("_n_gram"))
             .join(contexts, context_of(F.col("_gram")) == F.col("_context"))
             .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(
                 "k", "n", "total", "followers"))).alias("steps")))  # ORDER entries at most
    d = F.lit(POOLED_DISCOUNT)
    return steps.select("gram", F.aggregate(
        "steps", F.lit(1 / 256), lambda p, s: (F.greatest(s["n"] - d, F.lit(0.0))
                                               + d * s["followers"] * p) / s["total"]).alias("p"))


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log likelihood ratios, a written table of two kinds of rows.

    Grams some class has more than CLASS_DISCOUNT times have one of their own. A context of
    such grams (negative: its key's complement) has the one of everything else that follows.
    In all other contexts the classes agree.
    """
    gram, d = F.col("gram"), F.lit(CLASS_DISCOUNT)
    strong = F.greatest("c0", "c1") > d
    per_context = (counts.groupBy(context_of(gram).alias("_context")).agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("c0", "c1")],
        *[F.sum(F.least(F.col(c), d)).alias(f"f_{c}") for c in ("c0", "c1")],
        F.max(strong).alias("strong")).where("strong"))
    per_context = materialize(per_context, "class-contexts")
    own = materialize(counts.where(strong), "strong-grams")

    def chance(c: str, p: Column) -> Column:
        kept = F.greatest(F.col(c) - d, F.lit(0.0))
        return F.when(F.col(f"t_{c}") == 0, p).otherwise(
            (kept + F.col(f"f_{c}") * p) / F.col(f"t_{c}"))

    def left(c: str) -> Column:
        return F.when(F.col(f"t_{c}") == 0, F.lit(1.0)).otherwise(
            F.col(f"f_{c}") / F.col(f"t_{c}"))

    p = pooled(counts, own).withColumnRenamed("gram", "_gram")
    grams = (own.join(p, gram == F.col("_gram"))
             .join(per_context, context_of(gram) == F.col("_context"))
             .select("gram", F.log(chance("c1", F.col("p")) / chance("c0", F.col("p"))).alias("ratio")))
    rest = per_context.select((-F.col("_context") - 1).alias("gram"),
                              F.log(left("c1") / left("c0")).alias("ratio"))
    return materialize(grams.union(rest), "ratios")


class _Table:
    """Values by key: one slot per key hash, and a sorted list for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        at = self._slot(keys)
        first = np.unique(at, return_index=True)[1]
        self.keys = np.full(1 << self.bits, np.iinfo(np.int64).max)
        self.values = np.zeros(1 << self.bits)
        self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
        rest = np.ones(len(keys), dtype=bool)
        rest[first] = False
        order = np.argsort(keys[rest])
        self.more, self.more_values = keys[rest][order], values[rest][order]
        self.shared = np.zeros(1 << self.bits, dtype=bool)
        self.shared[at[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there) of each key."""
        at = self._slot(wanted)
        hit = self.keys[at] == wanted
        out = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & self.shared[at])
        if len(left):
            near = np.minimum(np.searchsorted(self.more, wanted[left]), len(self.more) - 1)
            found = self.more[near] == wanted[left]
            out[left[found]] = self.more_values[near[found]]
            hit[left[found]] = True
        return out, hit


class _Words:
    """Evidence of words for one task; words met before are remembered up to a number."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.table = _Table(keys, values) if len(keys) else None
        self.seen: set[bytes] = set()
        self.telling: dict[bytes, float] = {}  # those of ``seen`` with evidence

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """What each word adds: its log likelihood ratio beyond the margin."""
        if self.table is None:
            return np.zeros(len(words))
        gram, owner = grams_of(words)
        ratio, hit = self.table.find(gram)
        miss = np.flatnonzero(~hit)
        length, body = gram[miss] >> 56, gram[miss] & ((1 << 56) - 1)
        ratio[miss] = self.table.find(-(((length - 1) << 56) | (body >> 8)) - 1)[0]
        return np.maximum(np.bincount(owner, ratio, len(words)) - MARGIN, 0.0)

    def means(self, texts: list[str]) -> list[float]:
        out = []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            counts = [Counter(t.lower().encode("utf-8", "surrogatepass").split())
                      for t in texts[i:i + TEXTS_AT_ONCE]]
            if len(self.seen) > CACHED_WORDS:
                self.seen, self.telling = set(), {}
            new = list(set().union(*counts).difference(self.seen))
            for k in range(0, len(new), 20_000):
                part = new[k:k + 20_000]
                value = self.evidence(part)
                self.seen.update(part)
                self.telling.update((part[at], float(value[at])) for at in np.flatnonzero(value))
            for c in counts:
                told = self.telling.keys() & c.keys()
                out.append(math.fsum(self.telling[w] * c[w] for w in told) / max(1, c.total()))
        return out


def _local_means(rows: DataFrame, table: DataFrame) -> DataFrame:
    found = table.toArrow()  # LOCAL_GRAMS rows at most
    keys, values = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(keys)
    sent = rows.sparkSession.sparkContext.broadcast(
        (keys[order], values[order].astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.means(batch.column(1).to_pylist()), pa.float64())],
                names=["doc_id", "mean"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mean double")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n) of each text."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Counter(text.lower().encode("utf-8", "surrogatepass").split())
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(words), pa.int64()), pa.array(list(words), pa.binary()),
                 pa.array(list(words.values()), pa.int64())], names=["key", "word", "n"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gram) of each byte of each word."""
    for batch in batches:
        ids, words = batch.columns
        for i in range(0, len(words), 1000):
            gram, owner = grams_of(words.slice(i, 1000).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, 1000).take(pa.array(owner)), pa.array(gram)], names=["id", "gram"])


def _joined_means(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same means by joins, for a table of ratios of any size.

    Only words with evidence, which are few, meet the texts again.
    """
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    words = materialize(keyed.select("_key", "text").mapInArrow(
        _split, "key long, word binary, n long").groupBy("key", "word").agg(
        F.max("n").alias("n")).withColumn("id", F.unhex(F.md5("word"))), "text-words")
    spelt = words.select("id", "word").distinct().mapInArrow(_spell, "id binary, gram long")
    own = table.where("gram >= 0").select(F.col("gram").alias("_own"), F.col("ratio").alias("_r1"))
    rest = table.where("gram < 0").select((-F.col("gram") - 1).alias("_rest"),
                                          F.col("ratio").alias("_r2"))
    evidence = (spelt.join(own, F.col("gram") == F.col("_own"), "left")
                .join(rest, context_of(F.col("gram")) == F.col("_rest"), "left")
                .groupBy(F.col("id").alias("_id"))
                .agg((F.sum(F.coalesce("_r1", "_r2", F.lit(0.0))) - MARGIN).alias("more"))
                .where("more > 0"))
    evidence = materialize(evidence, "word-evidence")
    sums = words.join(evidence, F.col("id") == F.col("_id"), "left").groupBy("key").agg(
        (F.sum(F.coalesce("more", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("mean"))
    return keyed.join(sums, F.col("_key") == F.col("key"), "left").select(
        "doc_id", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def _calibrate(scored: DataFrame, marks: DataFrame) -> tuple[float, float]:
    """(offset, slope) of the odds over log mean, from counts per bin and class.

    Starts from even odds at a mean of 0.05 with slope 2, which weigh as much as a few rows,
    so tables with hardly any labels have a sensible threshold too.
    """
    bins = (scored.join(marks.where("calibrates"), F.col("doc_id") == F.col("_doc"))
            .groupBy(F.floor(F.log(F.col("mean") + _LEAST) * 32).alias("bin"), "toxic")
            .count().orderBy("bin", "toxic").collect())  # a few hundred bins at most
    x = np.array([(r["bin"] + 0.5) / 32 - _USUAL for r in bins])
    y = np.array([float(r["toxic"]) for r in bins])
    n = np.array([float(r["count"]) for r in bins])
    w = np.array([0.0, 2.0])
    design = np.stack([np.ones_like(x), x], axis=1) if len(x) else np.zeros((0, 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (y - p)) - (w - [0.0, 2.0])
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), max(0.1, float(w[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text",
                    local_grams: int = LOCAL_GRAMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score in (0, 1), predicted.

    Only the text enters a score, from its first to its last word, whatever its length. Labels
    of rows whose crc32(doc_id) modulo 3 is 1 are never read, and nor are labels without a
    doc_id. A null text is empty; texts without words share the lowest score. Repeated rows get
    a row each; a document with several labels counts as toxic if one of them says so. Other
    columns are not read. An empty table gives an empty result; without labels every word says
    nothing and all scores are equal and low.
    """
    marks = _marks(labels)
    table = ratios(materialize(class_counts(docs, marks, text), "class-counts"))
    rows = docs.select("doc_id", text_of(text).alias("text"))
    use = _local_means if table.count() <= local_grams else _joined_means
    scored = materialize(use(rows, table), "toxic-means")
    offset, slope = _calibrate(scored, marks)
    odds = offset + slope * (F.log(F.col("mean") + _LEAST) - _USUAL)
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))
    return (scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                          (1 / (1 + F.exp(-odds))).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
