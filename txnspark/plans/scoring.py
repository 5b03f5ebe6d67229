"""Scoring jobs: request rows in, scores or nested replies out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions import features as X
from txnspark.functions.rules import fallback_heads, fallback_score
from txnspark.operators import tokens
from txnspark.plans.training import HEAD_NAMES, Bundle
from txnspark.sources import documents

# --- fixed values: defaults of a scoring request (display name -> value) ---
REQUEST_DEFAULTS = {
    "Amount": "$120.00",
    "Merchant Name": "AMAZON",
    "Merchant City": "ONLINE",
    "Merchant State": "ONLINE",
    "Use Chip": "Online Transaction",
    "MCC": 5942,
    "Zip": "00000",
    "Time": "03:14",
    "Year": 2019,
    "Month": 11,
    "Day": 22,
    "Card": 0,
    "User": 0,
}
UNREADABLE_NUMBER = 0
# --- end of fixed values ---

FLAG_TEXT, CLEAR_TEXT = "FLAG · REVIEW", "CLEAR"


def canonical_request(form: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Request columns under either name, typed, with a default for each absent field."""
    names = {v: k for k, v in S.DISPLAY_NAMES.items()}
    out = [F.col(c) for c in keep]
    for display, default in REQUEST_DEFAULTS.items():
        given = display if display in form.columns else names[display]
        if given not in form.columns:
            value = F.lit(default)
        elif isinstance(default, str):
            value = F.coalesce(F.col(f"`{given}`").cast("string"), F.lit(default))
        else:
            text = F.col(f"`{given}`").cast("string")
            value = (F.when(text.isNull(), F.lit(default))
                     .otherwise(F.coalesce(text.try_cast("int"), F.lit(UNREADABLE_NUMBER))))
        out.append(value.alias(names[display]))
    return form.select(*out)


def request_features(rows: DataFrame) -> DataFrame:
    """The tolerant coercions used on request rows: never fails on odd text."""
    hour = F.col("hour") if "hour" in rows.columns else F.lit(None).cast("int")
    return rows.withColumns({
        "hour": X.tolerant_hour(hour, F.col("time")),
        "amount_num": X.tolerant_amount(F.col("amount")),
        "merchant_num": X.merchant_number(F.col("merchant_name").cast("string")),
        "zip_num": X.zip_number(F.coalesce(F.col("zip").cast("string"), F.lit(""))),
        "zip_text": X.zip_token_text(F.coalesce(F.col("zip").cast("string"), F.lit(""))),
    })


def fallback_reply(features: DataFrame) -> DataFrame:
    """One column per head from the fallback rule."""
    base = fallback_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
    return features.withColumns({f"p_{h}": p for h, p in fallback_heads(base).items()})


def verdict(p, threshold: float = S.FLAG_THRESHOLD):
    return F.when(p >= F.lit(threshold), FLAG_TEXT).otherwise(CLEAR_TEXT)


def score_requests(form: DataFrame, bundle: Bundle, key: str = "row_id") -> DataFrame:
    """(key, reply): the nested JSON reply of a trained bundle to each request row.

    Request columns may carry either name, be absent, or hold text where training saw
    numbers. Tokens, embedding and position come from the same steps as in training.
    """
    rows = request_features(canonical_request(form, [key])).withColumnRenamed(key, "row_id")
    scored = bundle.score(rows, "ids", "embedding").withColumn("dim", F.size("embedding"))
    told = tokens.decode(scored, bundle.vocabulary)
    heads = {h: F.col(f"p_{h}") for h in HEAD_NAMES}
    reply = documents.score_reply("model", F.col("strip"), F.col("dim"), heads, F.col("x"),
                                  F.col("y_pos"))
    return told.select(F.col("row_id").alias(key), reply.alias("reply"))
