"""Trees of branches: depth, ancestors, subtree sums, relative sizes, components with a least size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.operators.components import connected_components
from canopia.plans.shared import discard, materialize


def depths(nodes: DataFrame, key: list[str], parent: str = "parent", max_rounds: int = 40) -> DataFrame:
    """``key``, ``depth`` (steps from the root, which has no parent) and ``root``, by doubling jumps: as many rounds as the depth has binary digits.

    ``key`` is the group and the node, like ``["tree_id", "branch"]``. Nodes under a missing parent or in a circle have neither.
    """
    group, node = key[:-1], key[-1]
    state = materialize(nodes.select(*key, F.col(parent).alias("_up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce(parent, node).alias("root")), "depths")
    for _ in range(max_rounds):
        if state.where(F.col("_up").isNotNull()).isEmpty():
            break
        above = state.select(*group, F.col(node).alias("_up"), F.col("_up").alias("_up2"), F.col("depth").alias("_more"), F.col("root").alias("_root"), F.lit(True).alias("_found"))
        after = state.join(above, [*group, "_up"], "left").select(
            *key, F.col("_up2").alias("_up"), F.when(F.col("_up").isNull(), F.col("depth")).when(F.col("_found"), F.col("depth") + F.col("_more")).alias("depth"), F.coalesce("_root", "root").alias("root")
        )
        after = materialize(after, "depths")
        discard(state)
        state = after
    known = F.col("_up").isNull() & F.col("depth").isNotNull()
    return state.select(*key, F.when(known, F.col("depth")).alias("depth"), F.when(known, F.col("root")).alias("root"))


def ancestors(nodes: DataFrame, key: list[str], parent: str = "parent") -> DataFrame:
    """``key``, ``ancestor``, ``distance``: every node with all nodes above it and itself at distance 0; one join for each level.

    Raises ``ValueError`` if the parents go round in a circle: then a level is never empty.
    """
    group, node = key[:-1], key[-1]
    up = nodes.select(*group, F.col(node).alias("ancestor"), F.col(parent).alias("_next"))
    level = materialize(nodes.select(*key, F.col(node).alias("ancestor"), F.lit(0).alias("distance")), "ancestors")
    out, k, most = level, 0, None
    while True:
        k += 1
        level = materialize(level.join(up, [*group, "ancestor"]).where(F.col("_next").isNotNull()).select(*key, F.col("_next").alias("ancestor"), F.lit(k).alias("distance")), "ancestors")
        if level.isEmpty():
            return out
        if k % 64 == 0:  # above a node stand fewer nodes than there are, and one missing parent
            most = nodes.count() if most is None else most
            if k > most:
                raise ValueError("parents go round in a circle")
            out = materialize(out, "ancestors")
        out = out.unionByName(level)


def subtree_sums(nodes: DataFrame, key: list[str], value: str, parent: str = "parent") -> DataFrame:
    """Per node: number of nodes below it and the sum of ``value`` over itself and those."""
    a = ancestors(nodes, key, parent).join(nodes.select(*key, value), key)
    return a.groupBy(*key[:-1], F.col("ancestor").alias(key[-1])).agg((F.count(F.lit(1)) - 1).alias("n_below"), F.sum(value).alias(f"{value}_sum"))


def relative_sizes(branches: DataFrame, heights: DataFrame) -> DataFrame:
    """``tree_id, branch, size``: 1 to 256, falling with order and with the height of the branch's base (``height`` over ``tree_height``)."""
    top = branches.groupBy("tree_id").agg(F.max("branch_order").alias("_top"))
    b = branches.join(top, "tree_id").join(heights, ["tree_id", "branch"])
    share = (F.col("_top") - F.col("branch_order")) / F.nullif(F.col("_top"), F.lit(0)) * (F.col("tree_height") - F.col("height")) / F.col("tree_height")
    return b.select("tree_id", "branch", F.ceil(F.round(F.coalesce(share, F.lit(1.0)) * 256, 9)).cast("long").alias("size"))


def components(edges: DataFrame, nodes: DataFrame, min_size: int = 1) -> DataFrame:
    """``node, component``: nodes (a single column ``node``) of components with at least ``min_size`` of them; single nodes are components."""
    found = connected_components(edges)
    all_ = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    large = all_.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    return all_.join(large, "component", "left_semi").select("node", "component")
