"""Transactions as token sequences: build, fit a vocabulary, encode, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.hashing import bucket
from txnspark.operators.ordered import dense_ids
from txnspark.operators.quantiles import exact_quantiles
from txnspark.session import materialize

# --- fixed values: special tokens (ids in this order) and sequence layout ---
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
SHOWN_TOKENS = 16
# --- end of fixed values ---

SLOTS = ["t_amount", "t_merchant", "t_mcc", "t_hour", "t_chip", "t_state"]
EXTRA_SLOTS = ["t_dow", "t_gap", "t_mcc_group"]


def merchant_token(merchant, n: int = S.MERCHANT_BUCKETS, device: str = "md5") -> Column:
    return F.concat(F.lit("MERCH_"), bucket(merchant, n, device).cast("string"))


def amount_token(amount) -> Column:
    """Log-scale bucket; a refund or a missing amount counts as the zero bucket."""
    step = F.floor(F.log1p(F.greatest(amount, F.lit(0.0))) * 2)
    return F.concat(F.lit("AMT_"), step.cast("string"))


def with_slots(features: DataFrame, extra: bool = False) -> DataFrame:
    """One token column per slot. ``extra`` adds the temporal and category-group
    slots and needs ``ts`` and ``time_delta_s``. A missing value has a token of its own."""
    named = lambda prefix, text: F.concat(
        F.lit(prefix), F.coalesce(text, F.lit("NONE")))
    slots = {
        "t_amount": amount_token(F.col("amount_num")),
        "t_merchant": F.coalesce(merchant_token("merchant_name"), F.lit("MERCH_NONE")),
        "t_mcc": named("MCC_", F.col("mcc").cast("string")),
        "t_hour": named("HOUR_", F.col("hour").cast("string")),
        "t_chip": named("CHIP_", F.upper(F.split_part("use_chip", F.lit(" "), F.lit(1)))),
        "t_state": named("STATE_", F.col("merchant_state")),
    }
    if extra:
        gap = F.col("time_delta_s")
        slots |= {
            "t_dow": named("DOW_", F.weekday("ts").cast("string")),
            "t_gap": F.concat(F.lit("DT_"), F.when(gap.isNull(), "FIRST")
                              .when(gap < 60, "MINUTE").when(gap < 3600, "HOUR")
                              .when(gap < 86400, "DAY").when(gap < 604800, "WEEK")
                              .otherwise("LONG")),
            "t_mcc_group": named("MCCG_", F.floor(F.col("mcc") / 100).cast("string")),
        }
    return features.withColumns(slots)


def token_array(slots: list[str] = SLOTS) -> Column:
    return F.array(F.lit("<bos>"), *[F.col(s) for s in slots], F.lit("<eos>"))


def token_counts(slotted: DataFrame, slots: list[str] = SLOTS) -> DataFrame:
    """Occurrences per token. Map-side partials keep a frequent token from being hot."""
    return (slotted.select(F.explode(F.array(*slots)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def fit_vocabulary(slotted: DataFrame, slots: list[str] = SLOTS) -> DataFrame:
    """(token, id, n): special tokens first, then by falling count, then by text.

    Written to the shared folder: it is the fitted state that encode and decode
    reuse, and its size is known to the planner.
    """
    counts = materialize(token_counts(slotted, slots), "token-counts")
    counts = counts.withColumn("_down", -F.col("n"))
    ids = dense_ids(counts, ["_down", "token"], "pos")
    ordinary = ids.select("token", (F.col("pos") + len(SPECIALS)).cast("int").alias("id"), "n")
    special = slotted.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, n long")
    return materialize(special.unionByName(ordinary), "vocabulary")


def encode(slotted: DataFrame, vocabulary: DataFrame, slots: list[str] = SLOTS,
           length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """Adds ``ids``: <bos>, one id per slot (unknown -> <unk>), <eos>, padded or cut.

    One lookup join per slot, so rows are never exploded or regrouped. The
    planner broadcasts the written vocabulary while it is small and falls back to
    a shuffled join with skew handling when it is not.
    """
    out = slotted
    for slot in slots:
        lookup = vocabulary.select(F.col("token").alias(slot), F.col("id").alias(f"_{slot}"))
        out = out.join(lookup, slot, "left")
    ids = F.array(F.lit(BOS_ID), *[F.coalesce(F.col(f"_{s}"), F.lit(UNK_ID)) for s in slots],
                  F.lit(EOS_ID))
    return out.withColumn("ids", pad(ids, length)).drop(*[f"_{s}" for s in slots])


def pad(ids: Column, length: int = S.SEQUENCE_LENGTH) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), length)), 1, length)


def encode_arrays(df: DataFrame, vocabulary: DataFrame, tokens: str = "tokens",
                  key: str = "row_id", length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """(key, ids) for token arrays of any length; a row's tokens are one group."""
    lookup = vocabulary.select("token", "id")
    hits = (df.select(key, F.posexplode(F.slice(tokens, 1, length)).alias("at", "token"))
            .join(lookup, "token", "left")
            .groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
                "at", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("_hits")))
    return hits.select(key, pad(F.col("_hits.id"), length).alias("ids"))


def decode(encoded: DataFrame, vocabulary: DataFrame, key: str = "row_id",
           shown: int = SHOWN_TOKENS) -> DataFrame:
    """Adds ``strip``: the first ``shown`` tokens without padding, in order.

    One lookup join over the shown ids; a row without any keeps an empty strip.
    """
    reverse = vocabulary.select("id", "token")
    strips = (encoded.select(F.col(key).alias("_key"),
                             F.posexplode(F.slice("ids", 1, shown)).alias("at", "id"))
              .where(F.col("id") != PAD_ID).join(reverse, "id")
              .groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("_s"))
              .select("_key", F.col("_s.token").alias("_strip")))
    return (encoded.join(strips, F.col(key) == F.col("_key"), "left")
            .withColumn("strip", F.coalesce("_strip", F.array().cast("array<string>")))
            .drop("_key", "_strip"))


def unknown_tokens(slotted: DataFrame, vocabulary: DataFrame,
                   slots: list[str] = SLOTS) -> DataFrame:
    """Tokens missing from the vocabulary, with their counts; empty when all are known."""
    return token_counts(slotted, slots).join(vocabulary.select("token"), "token", "left_anti")


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: the exact quantile edges, smallest to largest, duplicates dropped."""
    q = exact_quantiles(df, column, [i / bins for i in range(bins + 1)])
    return q.agg(F.array_sort(F.collect_set("value")).alias("edges"))


def quantile_bin(df: DataFrame, column: str, edges: DataFrame, out: str) -> DataFrame:
    """Ordinal bin: how many inner edges are at or below the value."""
    e = edges.select(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))).scalar()
    return (df.withColumn("_e", e)
            .withColumn(out, F.size(F.filter("_e", lambda x: x <= F.col(column)))).drop("_e"))


def digitize(value, edges: list[float]) -> Column:
    """Index i with edges[i-1] <= value < edges[i]; 0 below the first edge."""
    return sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(0))
