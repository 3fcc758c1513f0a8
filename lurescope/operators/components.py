"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations with map-side combine and equi-joins, so that a vertex with a huge degree never has its
neighbours collected in one place; a table in the shared folder ends the lineage of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.runtime import staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another one.

    Null ends and loops are ignored; repeated edges count once. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = staged(_down(pairs).distinct(), "edges")
    before = None
    for _ in range(rounds):
        pairs = staged(_small_star(_large_star(pairs)), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _down(pairs: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller end."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the least vertex of its neighbourhood."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are tied to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
