"""Rule scores: deterministic stand-ins used when no trained head is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.functions.features import clamp
from txnspark.functions.hashing import normal

# --- fixed values: weights, offsets and clip limits of the rule scores ---
ONLINE_WEIGHT = 0.30
ODD_HOUR_WEIGHT = 0.22
ODD_HOURS = (1, 4)
AMOUNT_SCALE = 6000.0
AMOUNT_CEILING = 0.35
FALLBACK_BASE = 0.18
FALLBACK_NOISE = 0.05
FALLBACK_CLIP = (0.01, 0.98)
STUB_BASE = 0.24
STUB_NOISE = 0.04
HEAD_CLIP = (0.01, 0.99)
HEAD_OFFSETS = {"raw": -0.07, "embed": 0.05, "combined": 0.08}
# --- end of fixed values ---


def risk_signal(base: float, use_chip, hour, amount) -> Column:
    """A missing channel, hour or amount adds nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    online = zero(F.upper(use_chip).contains("ONLINE").cast("double"))
    odd = zero(hour.between(*ODD_HOURS).cast("double"))
    return (F.lit(base) + F.lit(ONLINE_WEIGHT) * online + F.lit(ODD_HOUR_WEIGHT) * odd
            + F.least(zero(amount) / F.lit(AMOUNT_SCALE), F.lit(AMOUNT_CEILING)))


def _noise(sigma: float, key, salt: str) -> Column:
    return F.lit(sigma) * normal(key, salt)


def fallback_score(use_chip, hour, amount, noise_key=None) -> Column:
    """Base score of the fallback rule; pass a key to add repeatable noise."""
    score = risk_signal(FALLBACK_BASE, use_chip, hour, amount)
    if noise_key is not None:
        score = score + _noise(FALLBACK_NOISE, noise_key, "fallback")
    return clamp(score, *map(F.lit, FALLBACK_CLIP))


def fallback_heads(base) -> dict[str, Column]:
    return {head: clamp(base + F.lit(offset), *map(F.lit, HEAD_CLIP))
            for head, offset in HEAD_OFFSETS.items()}


def stub_score(use_chip, hour, amount, noise_key=None) -> Column:
    """Score of the external stub; ``noise_key`` is any row key, e.g. a crc32."""
    score = risk_signal(STUB_BASE, use_chip, hour, amount)
    if noise_key is not None:
        score = score + _noise(STUB_NOISE, noise_key, "stub")
    return clamp(score, *map(F.lit, HEAD_CLIP))


def rule_scores(features: DataFrame, *extra: str) -> DataFrame:
    """Long form (row_id, y, head, p): three fallback heads and the stub head."""
    base = fallback_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
    stub = stub_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
    heads = {**fallback_heads(base), "external": stub}
    pairs = F.array(*[F.struct(F.lit(h).alias("head"), p.alias("p")) for h, p in heads.items()])
    return features.select("row_id", "y", *extra, F.inline(pairs))
