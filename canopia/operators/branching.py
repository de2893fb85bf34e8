"""Corrections of segments: small ones that lie along their parent go, stems and branches run on to their farthest tip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopia.functions.vectors import axis_distance, vector
from canopia.operators.graph import depths
from canopia.plans.shared import discard, materialize

#: Layers of the parent on either side of a child that its line is drawn through.
REACH = 10
#: A child is small if it stands out by less than this (metres), or by less than this share of the parent's width and that many metres.
OUT, OUT_SHARE, OUT_MOST = 0.02, 1.2, 0.06
#: A segment that goes on in a child keeps its own end if that has at most so many layers.
TAIL = 5


def remove_small(sets: DataFrame) -> DataFrame:
    """``sets`` without small segments; ``sets`` has ``tree_id, centre, layer, segment, parent_segment, x, y, z``, other columns stay.

    A child is held against the line between the middles of two layers of its parent, ten below and ten above where it begins (or the parent's ends). It is
    small if the farthest of its sets is hardly farther from that line than the farthest of the parent's between them. A small child without
    children goes; one whose children have none themselves goes with them if they are small beside the same line, too.
    """
    line = sets.groupBy("tree_id", "segment").agg(F.first("parent_segment").alias("parent"), F.min("layer").alias("_first"), F.max("layer").alias("_last"))
    line = materialize(line, "lines")
    up = line.select("tree_id", F.col("segment").alias("parent"), F.col("_first").alias("_p0"), F.col("_last").alias("_p1"))
    # The layer of the parent that a child begins at is the one before its own first.
    c = line.join(up, ["tree_id", "parent"]).withColumn("_at", F.least(F.greatest(F.col("_first") - 1, "_p0"), "_p1"))
    c = c.select("tree_id", "segment", "parent", F.greatest(F.col("_at") - REACH, "_p0").alias("_a"), F.least(F.col("_at") + REACH, "_p1").alias("_b"))
    middle = sets.groupBy("tree_id", F.col("segment").alias("parent"), F.col("layer").alias("_l")).agg(*[F.avg(k).alias(f"_m{k}") for k in "xyz"])
    end = lambda n: middle.select("tree_id", "parent", F.col("_l").alias(f"_{n}"), *[F.col(f"_m{k}").alias(f"_{n}{k}") for k in "xyz"])
    c = c.join(end("a"), ["tree_id", "parent", "_a"]).join(end("b"), ["tree_id", "parent", "_b"])
    way = [F.col(f"_b{k}") - F.col(f"_a{k}") for k in "xyz"]
    size = F.nullif(F.sqrt(sum((w * w for w in way[1:]), way[0] * way[0])), F.lit(0.0))
    c = materialize(c.select("tree_id", "segment", "parent", "_a", "_b", *[F.col(f"_a{k}") for k in "xyz"], *[(w / size).alias(f"_v{k}") for w, k in zip(way, "xyz", strict=True)]), "children")
    off = axis_distance(vector("x", "y", "z"), vector("_ax", "_ay", "_az"), vector("_vx", "_vy", "_vz"))[0]

    def farthest(of: DataFrame, segment: str, inside: bool = False) -> DataFrame:
        """Per child (and ``segment``) how far the sets of that segment are from the child's line."""
        j = of.join(sets.select("tree_id", F.col("segment").alias(segment), "layer", "x", "y", "z"), ["tree_id", segment])
        return (j.where(F.col("layer").between(F.col("_a"), F.col("_b"))) if inside else j).groupBy("tree_id", *dict.fromkeys(["segment", segment])).agg(F.max(off).alias(f"_far_{segment}"))

    far = farthest(c, "parent", True).drop("parent").join(farthest(c, "segment"), ["tree_id", "segment"])
    q = F.col("_far_parent")
    small = lambda r: ((r - q < OUT) | (r / F.nullif(q, F.lit(0.0)) < OUT_SHARE) & (r - q < OUT_MOST))
    beyond = F.greatest(q, "_far_segment")
    far = far.withColumn("_small", F.coalesce(small(beyond), F.lit(False)))
    kids = line.where(F.col("parent").isNotNull()).select("tree_id", F.col("parent").alias("segment"), F.col("segment").alias("kid"))
    count = kids.groupBy("tree_id", "segment").agg(F.count(F.lit(1)).alias("_kids"))
    base = far.where("_small").join(count, ["tree_id", "segment"], "left")
    base = materialize(base, "small")
    of_kids = base.where(F.col("_kids").isNotNull()).join(kids, ["tree_id", "segment"])
    own = count.select("tree_id", F.col("segment").alias("kid"), F.lit(True).alias("_more"))
    far_kids = farthest(of_kids.select("tree_id", "segment", "kid").join(c, ["tree_id", "segment"]), "kid")
    judged = of_kids.join(far_kids, ["tree_id", "segment", "kid"]).join(own, ["tree_id", "kid"], "left")
    judged = judged.withColumn("_ok", F.coalesce(small(F.greatest(beyond, "_far_kid")), F.lit(False)) & F.col("_more").isNull())
    whole = materialize(judged.groupBy("tree_id", "segment").agg(F.min("_ok").alias("_ok")).where("_ok").select("tree_id", "segment"), "whole")
    gone = base.where(F.col("_kids").isNull()).select("tree_id", "segment").unionByName(whole).unionByName(kids.join(whole, ["tree_id", "segment"]).select("tree_id", F.col("kid").alias("segment")))
    return sets.join(materialize(gone.distinct(), "gone"), ["tree_id", "segment"], "left_anti").select(*sets.columns)


def _marked_above(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """``tree_id, node``: the marked nodes and all above them, by jumps that double."""
    jump = nodes.where(F.col("up").isNotNull()).select("tree_id", "node", "up")
    found = materialize(marks.select("tree_id", "node").distinct(), "marked")
    while not jump.isEmpty():
        more = found.join(jump, ["tree_id", "node"]).select("tree_id", F.col("up").alias("node"))
        after = materialize(found.unionByName(more).distinct(), "marked")
        discard(found)
        found = after
        far = jump.select("tree_id", F.col("node").alias("up"), F.col("up").alias("_up"))
        jump = materialize(jump.join(far, ["tree_id", "up"]).select("tree_id", "node", F.col("_up").alias("up")), "jumps")
    return found


def lengthen(layers: DataFrame, stem_only: bool = False, tail: int = TAIL) -> DataFrame:
    """``tree_id, node, segment, parent_segment``: the segments after stems run on to the highest set and branches to their farthest tip.

    ``layers`` has a row for each layer of each segment: ``tree_id, node, up`` (the layer below, null at the foot), ``segment, layer, x, y, z`` (its middle) and
    ``top``. Order by order, for all trees at once: the stem goes to the end of the segment with the highest ``top``, a branch to the segment's end that is
    farthest from its first layer, among all segments that grow from it. What it passes becomes one segment, named by its first node; the
    rest of its own old segment joins it if that is short (``tail`` layers), else is a branch of its own that stays as it is; the rests of the
    others, and what hangs on all of these, are the branches of the next order. With ``stem_only`` the branches stay as they are. The number of rounds is that of
    the orders that come out.
    """
    last = Window.partitionBy("tree_id", "segment")
    rest = materialize(layers.select("tree_id", "node", "up", "segment", "layer", "x", "y", "z", "top", (F.col("layer") == F.max("layer").over(last)).alias("_end"), F.max("top").over(last).alias("_top"), F.lit(False).alias("_stays")), "layers")
    done, order = None, 0
    while not rest.isEmpty():
        root = depths(rest.select("tree_id", "node", "up"), ["tree_id", "node"], "up").select("tree_id", "node", "root")
        first = rest.select("tree_id", F.col("node").alias("root"), F.col("segment").alias("_s0"), F.col("_stays").alias("_keep"), *[F.col(c).alias(f"_{c}0") for c in "xyz"])
        named = materialize(rest.join(root, ["tree_id", "node"]).join(first, ["tree_id", "root"]), "rooted")
        far = sum(((F.col(c) - F.col(f"_{c}0")) * (F.col(c) - F.col(f"_{c}0")) for c in "yz"), (F.col("x") - F.col("_x0")) * (F.col("x") - F.col("_x0")))
        reach = F.col("_top") if order == 0 else F.when(F.col("_keep"), F.when(F.col("segment") == F.col("_s0"), 1.0).otherwise(0.0)).otherwise(far)
        best = F.max(F.struct(reach.alias("r"), (-F.col("segment")).alias("s"), "node"))
        tips = named.where("_end").groupBy("tree_id", "root").agg(best.alias("_b")).select("tree_id", F.col("_b.node").alias("node"))
        path = _marked_above(rest, tips).withColumn("_on", F.lit(True))
        named = named.join(path, ["tree_id", "node"], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
        own = (F.col("segment") == F.col("_s0")) & ~F.col("_on")
        left = F.sum(own.cast("int")).over(Window.partitionBy("tree_id", "root"))
        named = materialize(named.withColumn("_on", F.col("_on") | own & (left <= tail)), "chosen")
        taken = named.where("_on").select("tree_id", "node", F.col("root").alias("segment"))
        done = materialize(taken if done is None else done.unionByName(taken), "segments")
        above = taken.select("tree_id", F.col("node").alias("up"), F.lit(True).alias("_cut"))
        free = named.where(~F.col("_on")).join(above, ["tree_id", "up"], "left")
        stays = F.when(F.col("_cut"), F.lit(stem_only) | (F.col("segment") == F.col("_s0"))).otherwise(F.lit(False))
        rest = materialize(free.select("tree_id", "node", F.when(F.col("_cut").isNull(), F.col("up")).alias("up"), "segment", "layer", "x", "y", "z", "top", "_end", "_top", stays.alias("_stays")), "layers")
        order += 1
    if done is None:
        return layers.select("tree_id", "node", F.col("segment").alias("segment"), F.col("segment").alias("parent_segment"))
    below = layers.select("tree_id", F.col("node").alias("segment"), "up").join(done.select("tree_id", F.col("node").alias("up"), F.col("segment").alias("parent_segment")), ["tree_id", "up"], "left").select("tree_id", "segment", "parent_segment")
    return done.join(below, ["tree_id", "segment"], "left").select("tree_id", "node", "segment", "parent_segment")
