"""Connected components by alternating large-star and small-star rounds.

Every round is one aggregation and one join on the edge table. Edges only ever
point from a node to a smaller one, the table never grows, and the number of
rounds is about the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(node, other, least): each pair beside the least node of its star."""
    least = (pairs.groupBy("node").agg(F.min("other").alias("m"))
             .select(F.col("node").alias("_n"), F.least("node", "m").alias("least")))
    return pairs.join(least, pairs["node"] == least["_n"]).drop("_n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("node", "other").union(
        edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return (_star(both).where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .where("node <> other").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges already point to the smaller node.
    starred = _star(edges)
    kept = starred.select(F.col("other").alias("node"), F.col("least").alias("other"))
    own = starred.select("node", F.col("least").alias("other"))
    return kept.union(own).where("node <> other").distinct()


def _print_of(edges: DataFrame):
    mark = F.xxhash64("node", "other").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b): root is its least reachable node.

    ``links`` may repeat pairs and hold loops and either direction. An empty
    table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        links.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .distinct(), "links")
    before = _print_of(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = _print_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("other").alias("node")).distinct()
    return (edges.select("node", F.col("other").alias("root"))
            .union(roots.select("node", F.col("node").alias("root"))))
