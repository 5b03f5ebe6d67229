"""Repeatable pseudo-random numbers derived from a row key.

The draw depends on nothing but the key and the salt, so any cluster layout,
retry or engine reproduces it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key ':' salt)."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normal(key, salt: str) -> Column:
    """A standard normal number by the Box-Muller rule on two uniform draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(key, f"{salt}.r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(key, f"{salt}.a"))


def normal_number(key: str, salt: str) -> float:
    """The draw ``normal`` makes for a constant key, as a number."""
    def draw(part: str) -> float:
        return int(hashlib.md5(f"{key}:{salt}.{part}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return math.sqrt(-2.0 * math.log(1.0 - draw("r"))) * math.cos(2.0 * math.pi * draw("a"))


def integers(key, salt: str, low: int, high: int) -> Column:
    """A whole number in [low, high)."""
    return (F.floor(uniform(key, salt) * F.lit(float(high - low))) + F.lit(low)).cast("bigint")


def choice(key, salt: str, values: list, weights: list[float] | None = None) -> Column:
    """One of ``values``, by cumulative weight."""
    weights = weights or [1.0 / len(values)] * len(values)
    draw, total, picked = uniform(key, salt), 0.0, None
    for value, weight in zip(values[:-1], weights[:-1]):
        total += weight
        hit = draw < F.lit(total)
        picked = F.when(hit, F.lit(value)) if picked is None else picked.when(hit, F.lit(value))
    return F.lit(values[-1]) if picked is None else picked.otherwise(F.lit(values[-1]))


def bernoulli(key, salt: str, p) -> Column:
    return uniform(key, salt) < p


def bucket(col, n: int, device: str = "md5") -> Column:
    """Bucket 0..n-1 of a high-cardinality value.

    ``md5`` gives the same bucket in any SQL engine, ``xxhash64`` is the faster
    JVM hash.
    """
    col = F.col(col) if isinstance(col, str) else col
    if device == "xxhash64":
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    return F.floor(uniform(col, "bucket") * F.lit(float(n))).cast("int")
