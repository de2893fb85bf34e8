"""Surfaces: cylinders as meshes, leaves, octree boxes for facets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.functions.vectors import orthonormal, vector


def cylinder_vertices(cylinders: DataFrame, sides: int = 24) -> DataFrame:
    """``tree_id, cyl, v, x, y, z``: the two end circles (v below 2 * sides) and the two end centres of each cylinder."""
    a, b = orthonormal(vector("ax", "ay", "az"))
    k = F.col("v") % sides
    angle = k * (2 * math.pi / sides)
    ring = F.col("v") < 2 * sides
    end = F.when(ring, F.floor(F.col("v") / sides)).otherwise(F.col("v") - 2 * sides).cast("double")
    r = F.when(ring, F.col("radius")).otherwise(0.0)
    c = cylinders.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * sides + 1))))
    at = [F.col(f"s{n}") + F.col(f"a{n}") * F.col("length") * end + r * (F.cos(angle) * p + F.sin(angle) * q) for n, p, q in zip("xyz", a, b, strict=True)]
    return c.select("tree_id", "cyl", "v", *[x.alias(n) for n, x in zip("xyz", at, strict=True)])


def cylinder_faces(cylinders: DataFrame, sides: int = 24) -> DataFrame:
    """``tree_id, cyl, f, v1, v2, v3``: two triangles a side, and a fan at each end; 4 * sides in all."""
    k, part = (F.col("f") % sides).cast("int"), F.floor(F.col("f") / sides)
    after = (k + 1) % sides
    pick = lambda *v: F.when(part == 0, v[0]).when(part == 1, v[1]).when(part == 2, v[2]).otherwise(v[3]).cast("int")
    c = cylinders.select("tree_id", "cyl", F.explode(F.sequence(F.lit(0), F.lit(4 * sides - 1))).alias("f"))
    return c.select("tree_id", "cyl", "f", pick(k, after, F.lit(2 * sides), F.lit(2 * sides + 1)).alias("v1"), pick(after, after + sides, after, k + sides).alias("v2"), pick(k + sides, k + sides, k, after + sides).alias("v3"))


def leaf_vertices(leaves: DataFrame, base: list[tuple[float, float, float]]) -> DataFrame:
    """``leaf_id, v, x, y, z``: the base leaf scaled, turned (its length along ``d``, its face to ``n``) and moved to each leaf's place."""
    rows = F.array(*[F.struct(F.lit(i).alias("v"), *[F.lit(float(c)).alias(f"b{n}") for n, c in zip("xyz", p, strict=True)]) for i, p in enumerate(base)])
    d, n = vector("dx", "dy", "dz"), vector("nx", "ny", "nz")
    side = [n[1] * d[2] - n[2] * d[1], n[2] * d[0] - n[0] * d[2], n[0] * d[1] - n[1] * d[0]]
    out = leaves.select("*", F.inline(rows))
    at = [F.col(f"o{m}") + F.col("scale") * (F.col("bx") * s + F.col("by") * u + F.col("bz") * w) for m, s, u, w in zip("xyz", side, d, n, strict=True)]
    return out.select("leaf_id", "v", *[x.alias(m) for m, x in zip("xyz", at, strict=True)])


def octree_boxes(facets: DataFrame, most: int, deepest: int = 12) -> DataFrame:
    """``tree_id, depth, bx, by, bz, n``: boxes of the shallowest octree with at most ``most`` facets in a box (or ``deepest``).

    ``facets`` have ``tree_id, fid`` and corners ``x1 .. z3``; a facet lies in the box of its lowest corner on each axis. All depths
    are counted in one pass.
    """
    low = {c: F.least(*[F.col(f"{c}{k}") for k in (1, 2, 3)]) for c in "xyz"}
    high = {c: F.greatest(*[F.col(f"{c}{k}") for k in (1, 2, 3)]) for c in "xyz"}
    box = facets.groupBy("tree_id").agg(*[F.min(low[c]).alias(f"_{c}0") for c in "xyz"], *[F.max(high[c]).alias(f"_{c}1") for c in "xyz"])

    def index(c: str) -> Column:
        size = F.nullif(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0))
        cells = F.pow(F.lit(2.0), F.col("depth"))
        return F.least(F.coalesce(F.floor((low[c] - F.col(f"_{c}0")) / size * cells), F.lit(0)), cells.cast("long") - 1).alias(f"b{c}")

    counted = (
        facets.join(box, "tree_id").withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
        .select("tree_id", "depth", *[index(c) for c in "xyz"]).groupBy("tree_id", "depth", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"))
    )
    fullest = counted.groupBy("tree_id", "depth").agg(F.max("n").alias("_n"))
    chosen = fullest.groupBy("tree_id").agg(F.coalesce(F.min(F.when(F.col("_n") <= most, F.col("depth"))), F.max("depth")).alias("depth"))
    return counted.join(chosen, ["tree_id", "depth"])


def leaf_density(blocks: DataFrame, low: float = 0.95, high: float = 0.7) -> DataFrame:
    """``blocks`` with ``density``: share of the leaf area by relative position along the branch, order and relative height.

    Leaves stand beyond a cutoff that falls from ``low`` (order 0) to ``high`` (order 4 and more); weight grows from there
    to the tip, times 0.2 at the ground to 1 at the top; shares add up to 1 in each tree.
    """
    cutoff = F.lit(low) + (high - low) * F.least(F.col("branch_order"), F.lit(4)) / 4
    weight = F.greatest((F.col("position") - cutoff) / (F.lit(1.0) - cutoff), F.lit(0.0)) * (F.lit(0.2) + F.col("height") * 0.8)
    b = blocks.withColumn("_w", weight)
    total = b.groupBy("tree_id").agg(F.sum("_w").alias("_t"))
    return b.join(total, "tree_id").withColumn("density", F.col("_w") / F.nullif(F.col("_t"), F.lit(0.0))).drop("_w", "_t")


def cylinder_grid(cylinders: DataFrame, steps: int = 100) -> DataFrame:
    """``tree_id, cyl, i, j, x, y, z``: ``steps`` places along each cylinder by as many around it, both ends and the full turn included."""
    a, b = orthonormal(vector("ax", "ay", "az"))
    c = cylinders.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    along, angle = F.col("i") / (steps - 1) * F.col("length"), F.col("j") / (steps - 1) * (2 * math.pi)
    at = [F.col(f"s{n}") + F.col(f"a{n}") * along + F.col("radius") * (F.sin(angle) * p + F.cos(angle) * q) for n, p, q in zip("xyz", a, b, strict=True)]
    return c.select("tree_id", "cyl", "i", "j", *[x.alias(n) for n, x in zip("xyz", at, strict=True)])
