"""Mixing sources to target weights by fractional repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark.llm.common import WORD, text_of
from txnspark.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEEDS = 32
_SPAN = 1 << 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """(source, source_size, target): tokens wanted from each source.

    ``sizes``: (source, source_size), one row per source. In code-point order, null last,
    sources weigh 5, 2, 1, 5, ... and share ``share`` times all tokens by weight; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight,
    until none is above. Capped sources are those with the smallest size per weight, so one
    ordered pass finds the level all others share.
    """
    at = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(at) - 1) % len(weights)) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_cap.rowsBetween(W.unboundedPreceding, -1)
    d = sizes.withColumn("weight", weight).withColumn("cap", cap)
    d = (d.withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
         .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(
             by_cap.rowsBetween(0, W.unboundedFollowing))))
    # With all before it capped, a source is below its cap if its share of the rest is. The
    # first such source has the level; capping those after it would only lower theirs.
    level = (F.col("all") - F.col("capped")) / F.col("open")
    d = d.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    level = F.max("level").over(W.partitionBy())
    return d.withColumn("shared", level).select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("shared") * F.col("weight"), F.col("cap")))
        .alias("target"))


def _draw(seed: Column) -> Column:
    """In [0, 1): both words of the row's hash, so each seed has its own even draw."""
    return F.pmod(F.col("_mix_a") + seed * F.col("_mix_b"), F.lit(_SPAN)) / F.lit(float(_SPAN))


def _with_copies(docs: DataFrame, text: str, seeds: int) -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.md5(text_of(text).cast("binary"))))
    word = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("long")
    measured = (docs.withColumn("_mix_size", word_count(text_of(text)))
                .withColumn("_mix_a", word(1)).withColumn("_mix_b", word(9)))
    small = materialize(measured.select(
        "source", F.col("_mix_size").alias("size"), "_mix_a", "_mix_b"), "mix-sizes")
    targets = materialize(source_targets(
        small.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    rate = F.least(F.lit(float(MOST)), F.coalesce(
        F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    rated = targets.select(F.col("source").alias("_mix_source"), "source_size", "target",
                           F.floor(rate).alias("_mix_whole"),
                           (rate - F.floor(rate)).alias("_mix_part"))
    extra = lambda s: F.sum(F.when(_draw(F.lit(s)) < F.col("_mix_part"),
                                   F.col("size")).otherwise(0)).alias(f"_x{s}")
    tried = (small.join(rated.select("_mix_source", "_mix_part"),
                        F.col("source").eqNullSafe(F.col("_mix_source")))
             .groupBy(F.col("_mix_source").alias("_tried"))
             .agg(*[extra(s) for s in range(seeds)]))
    off = F.array(*[F.struct(
        F.abs(F.col("source_size") * F.col("_mix_whole") + F.col(f"_x{s}") - F.col("target"))
        .alias("off"), F.lit(s).alias("seed")) for s in range(seeds)])
    chosen = materialize(
        rated.join(tried, F.col("_mix_source").eqNullSafe(F.col("_tried")))
        .withColumn("_mix_seed", F.array_min(off)["seed"].cast("long"))
        .select("_mix_source", F.col("source_size").alias("_mix_source_size"),
                F.col("target").alias("_mix_target"), "_mix_whole", "_mix_part", "_mix_seed"),
        "mix-rates")
    return (measured.join(chosen, measured["source"].eqNullSafe(chosen["_mix_source"]))
            .withColumn("_mix_copies", F.col("_mix_whole") + F.when(
                _draw(F.col("_mix_seed")) < F.col("_mix_part"), 1).otherwise(0)))


def mix(docs: DataFrame, text: str = "text", seeds: int = SEEDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each row is taken.

    The rate of a source is target / source_size. Each row is taken floor(rate) times, and
    once more if its hash-seeded draw is below the fraction of the rate, so never more than
    twice. Of ``seeds`` fixed seeds each source uses the one whose copies come nearest to
    its target in words; all seeds are tried in one pass. The result depends on nothing
    but the rows, whatever the layout or the number of runs.

    The draw is keyed by doc_id and text, so copies under other doc_ids draw on their own
    and repeated rows share their draw. Size is the number of words; a null or empty text
    has none and counts nothing. Rows of a null source form a source. Other columns are
    not read. An empty table gives an empty result.
    """
    return _with_copies(docs, text, seeds).select(
        "doc_id", "source", F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        F.col("_mix_copies").alias("copies"))


def mixed_documents(docs: DataFrame, text: str = "text", seeds: int = SEEDS) -> DataFrame:
    """The rows the mix takes, each as often as it is taken, with all columns of ``docs``."""
    return (_with_copies(docs, text, seeds)
            .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col(
                "_mix_copies").cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
r AS (SELECT doc_id, source, size, ('0x' || substr(k, 1, 8))::BIGINT AS a,
             ('0x' || substr(k, 9, 8))::BIGINT AS b FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]
             AS weight, source_size * 2e0 AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () * 1.5e0 AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
      FROM w),
l AS (SELECT max((total - capped) / opened)
             FILTER (WHERE (total - capped) / opened * weight < cap) AS level FROM o),
t AS (SELECT source, source_size,
             least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM o),
q AS (SELECT *, least(2e0, coalesce(target / nullif(source_size, 0), 0e0)) AS rate FROM t),
n AS (SELECT r.doc_id, r.size, q.source, q.source_size, q.target, floor(q.rate)::BIGINT AS whole,
             q.rate - floor(q.rate) AS part, r.a, r.b
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
x AS (SELECT source, seed, abs(any_value(source_size * whole)
             + sum(CASE WHEN ((a + seed * b) % 4294967296) / 4294967296e0 < part THEN size ELSE 0 END)
             - any_value(target)) AS off
      FROM n, range(32) g(seed) GROUP BY source, seed),
c AS (SELECT source, first(seed ORDER BY off, seed) AS seed FROM x GROUP BY source)
SELECT n.doc_id, n.size, n.source_size, n.target,
       (n.size * (whole + CASE WHEN ((a + seed * b) % 4294967296) / 4294967296e0 < part
                          THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source
"""
