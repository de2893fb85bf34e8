"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.plans.shared import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that an edge joins to another; component is the smallest node.

    Undirected; self loops, repeated edges and edges with a null end are ignored; an empty edge table
    gives an empty result. Every step is a min-aggregation and an equi-join, so a hub with any number of
    neighbours is pre-aggregated and split by Spark; the stars shrink to one edge per node.
    """
    a, b = F.col(src), F.col(dst)
    table = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = _mark(table)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after = materialize(_small_star(_large_star(table)), "stars")
        new = _mark(after)
        discard(table)
        table = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    )
