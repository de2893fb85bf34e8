"""From cover sets to branches: layers grown from the base, their components, chains of components as segments, cylinders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopia.operators import graph
from canopia.operators.components import connected_components
from canopia.operators.fitting import fit_cylinders
from canopia.plans.shared import materialize


def layers(points: DataFrame, members: DataFrame, neighbours: DataFrame, base_band: float, max_layers: int = 5000) -> DataFrame:
    """``tree_id, centre, layer``: steps over neighbouring sets from those whose centre is within ``base_band`` of the lowest.

    The front alone is joined in each round, for all trees at once. As neighbours are neighbours both ways, a step from a layer leads to that layer, the
    one before or the next, so only the last two are looked at to find what is new. Sets that the base does not reach have no row.
    """
    own = members.select("tree_id", F.col("centre").alias("pid")).distinct()
    centres = points.join(own, ["tree_id", "pid"]).select("tree_id", F.col("pid").alias("centre"), "z")
    low = centres.groupBy("tree_id").agg(F.min("z").alias("_low"))
    edges = materialize(neighbours, "neighbours")
    front = materialize(centres.join(low, "tree_id").where(F.col("z") <= F.col("_low") + base_band).select("tree_id", "centre", F.lit(0).cast("long").alias("layer")), "front")
    reached, before = front, front
    for k in range(1, max_layers + 1):
        step = edges.join(front.select("tree_id", F.col("centre").alias("a")), ["tree_id", "a"]).select("tree_id", F.col("b").alias("centre")).distinct()
        last_two = before.unionByName(front).select("tree_id", "centre")
        before, front = front, materialize(step.join(last_two, ["tree_id", "centre"], "left_anti").withColumn("layer", F.lit(k).cast("long")), "front")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if k % 20 == 0:  # a flat table in place of a long union
            reached = materialize(reached, "reached")
    raise RuntimeError(f"layers did not end in {max_layers} rounds")


def segments(points: DataFrame, members: DataFrame, neighbours: DataFrame, base_band: float) -> DataFrame:
    """``tree_id, centre, layer, component, segment, parent_segment``: cover sets with the branch that they belong to.

    Neighbouring sets of one layer are a component. A component hangs on the one before it that it shares most neighbours
    with; the one with the most points among those that hang on another carries its segment on, the others begin new ones.
    A segment is named by its first component.
    """
    layer = materialize(layers(points, members, neighbours, base_band), "layers")
    a = layer.select("tree_id", F.col("centre").alias("a"), F.col("layer").alias("_la"))
    b = layer.select("tree_id", F.col("centre").alias("b"), F.col("layer").alias("_lb"))
    joined = materialize(neighbours.join(a, ["tree_id", "a"]).join(b, ["tree_id", "b"]), "layered")
    same = joined.where("_la = _lb").select(F.col("a").alias("src"), F.col("b").alias("dst"))  # centres are numbers of points, one tree each
    found = connected_components(same)
    sets = layer.join(found, F.col("centre") == F.col("node"), "left").select("tree_id", "centre", "layer", F.coalesce("component", "centre").alias("component"))
    sets = materialize(sets, "sets")
    name = sets.select("tree_id", F.col("centre").alias("_c"), F.col("component").alias("_n"))
    up = (
        joined.where("_la = _lb + 1").select("tree_id", "a", "b").join(name.select("tree_id", F.col("_c").alias("a"), F.col("_n").alias("component")), ["tree_id", "a"])
        .join(name.select("tree_id", F.col("_c").alias("b"), F.col("_n").alias("above")), ["tree_id", "b"]).groupBy("tree_id", "component", "above").agg(F.count(F.lit(1)).alias("_n"))
    )
    size = sets.join(members.groupBy("tree_id", "centre").agg(F.count(F.lit(1)).alias("_p")), ["tree_id", "centre"]).groupBy("tree_id", "component").agg(F.sum("_p").alias("_size"))
    above = up.groupBy("tree_id", "component").agg(F.max_by("above", F.struct("_n", -F.col("above"))).alias("above"))
    tree = size.join(above, ["tree_id", "component"], "left")
    order = Window.partitionBy("tree_id", "above").orderBy(F.desc("_size"), "component")
    tree = tree.withColumn("_carry", F.when(F.col("above").isNotNull() & (F.row_number().over(order) == 1), F.col("above")))
    tree = materialize(tree, "component_tree")
    head = graph.depths(tree, ["tree_id", "component"], "_carry").select("tree_id", "component", F.col("root").alias("segment"))
    named = tree.join(head, ["tree_id", "component"])
    first = named.where("component = segment").select("tree_id", "segment", F.col("above").alias("_above"))
    first = first.join(head.select("tree_id", F.col("component").alias("_above"), F.col("segment").alias("parent_segment")), ["tree_id", "_above"], "left")
    out = sets.join(head, ["tree_id", "component"]).join(first.select("tree_id", "segment", "parent_segment"), ["tree_id", "segment"])
    return out.select("tree_id", "centre", "layer", "component", "segment", "parent_segment")


def cylinders(points: DataFrame, members: DataFrame, sets: DataFrame, layers: int = 4, least: int = 10) -> DataFrame:
    """Cylinders fitted to every ``layers`` layers of a segment, numbered along it (``region``), with the order of the segment.

    Regions with fewer than ``least`` points have none.
    """
    seg = sets.select("tree_id", "segment", "parent_segment").distinct()
    order = graph.depths(seg, ["tree_id", "segment"], "parent_segment").select("tree_id", "segment", F.col("depth").alias("branch_order"))
    start = sets.groupBy("tree_id", "segment").agg(F.min("layer").alias("_first"))
    region = sets.join(start, ["tree_id", "segment"]).withColumn("region", F.floor((F.col("layer") - F.col("_first")) / layers).cast("long"))
    p = points.join(members.select("tree_id", "pid", "centre"), ["tree_id", "pid"]).join(region.select("tree_id", "centre", "segment", "region"), ["tree_id", "centre"])
    fitted = fit_cylinders(p, ["tree_id", "segment", "region"], least)
    return fitted.join(order, ["tree_id", "segment"])


def layer_table(points: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each layer of each segment, as :func:`canopia.operators.branching.lengthen` takes it: ``tree_id, node, up, segment, layer, x, y, z, top``."""
    p = points.withColumnRenamed("pid", "centre").select("tree_id", "centre", "x", "y", "z")
    n = sets.join(p, ["tree_id", "centre"]).groupBy("tree_id", F.col("component").alias("node"), "segment", "parent_segment", "layer").agg(*[F.avg(c).alias(c) for c in "xyz"], F.max("z").alias("top"))
    n = materialize(n, "layer_table")
    under = lambda segment, name: n.select("tree_id", F.col("segment").alias(segment), (F.col("layer") + 1).alias("layer"), F.col("node").alias(name))
    out = n.join(under("segment", "_own"), ["tree_id", "segment", "layer"], "left").join(under("parent_segment", "_parent"), ["tree_id", "parent_segment", "layer"], "left")
    return out.select("tree_id", "node", F.coalesce("_own", "_parent").alias("up"), "segment", "layer", "x", "y", "z", "top")
