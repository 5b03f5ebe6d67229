"""Exact quantiles without gathering a column in one task.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here the distinct values are counted, scanned in order by the distributed
prefix sum, and only the two values around each wanted position are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.operators.ordered import prefix_sum
from txnspark.session import materialize


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float],
                    group_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """(group, i, value): value of ``probabilities[i]``, linear between neighbours."""
    group = list(group_by or [])
    counts = materialize(
        df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("c")), "value-counts")
    running = prefix_sum(counts, ["v"], {"cum": "c"}, group, ranges)
    if group:
        sizes = counts.groupBy(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)]).agg(
            F.sum("c").alias("n"))
        same = F.lit(True)
        for i, g in enumerate(group):  # a null group is a group
            same = same & F.col(g).eqNullSafe(F.col(f"_s{i}"))
        running = running.join(sizes, same)
    else:
        running = running.withColumn("n", counts.agg(F.sum("c")).scalar())
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in probabilities]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.floor(p).alias("low"), F.ceil(p).alias("high"),
                 (p - F.floor(p)).alias("part")) for i, p in enumerate(at)])
    first, last = F.col("cum") - F.col("c"), F.col("cum") - 1  # positions this value fills
    hits = running.select(*group, "v", first.alias("first"), last.alias("last"), F.inline(
        F.filter(wanted, lambda w: w["low"].between(first, last)
                 | w["high"].between(first, last))))
    pick = lambda c: F.max(F.when(F.col(c).between(F.col("first"), F.col("last")), F.col("v")))
    return (hits.groupBy(*group, "i")
            .agg(pick("low").alias("lo"), pick("high").alias("hi"), F.max("part").alias("part"))
            .select(*group, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
                    .alias("value")))
