"""Connected components of an edge table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every node
hands its larger neighbours to its smallest one, then its smaller ones, until only
stars are left. Each round is two aggregations and two joins; a node with many
neighbours is reduced to a minimum before the shuffle, and the join that hands them
on can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b), any order, repeats and loops allowed. Returns (node, component): one row for
    each node that isn't its component's smallest; component is the smallest node."""
    edges = written(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        after = written(_small_star(_large_star(edges).distinct()).distinct(), "links")
        discard(edges)
        edges = after
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
