"""Tree attributes from cylinders and branches: totals, height, diameter, orders, size classes, taper, branch tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.functions.vectors import angle_deg, vector

BREAST_HEIGHT = 1.3


def volume() -> Column:
    """Litres of a cylinder in metres."""
    return F.col("radius") * F.col("radius") * F.col("length") * (1000 * math.pi)


def area() -> Column:
    """Side of a cylinder in square metres."""
    return F.col("radius") * F.col("length") * (2 * math.pi)


def totals(cylinders: DataFrame) -> DataFrame:
    """Per tree: volumes in litres, lengths in metres and area in square metres, trunk and branches apart."""
    trunk = F.col("branch_order") == 0
    part = lambda x, cond: F.sum(F.when(cond, x).otherwise(0.0))
    return cylinders.groupBy("tree_id").agg(
        F.sum(volume()).alias("total_volume"), part(volume(), trunk).alias("trunk_volume"), part(volume(), ~trunk).alias("branch_volume"),
        part(F.col("length"), trunk).alias("trunk_length"), part(F.col("length"), ~trunk).alias("branch_length"), F.sum(area()).alias("area"),
        F.countDistinct("branch").alias("n_branches"), F.max("branch_order").alias("max_order"), F.count(F.lit(1)).alias("n_cylinders"),
    )


def height(cylinders: DataFrame, to_tip: bool = False) -> DataFrame:
    """Per tree: the highest start, raised by its own cylinder if that points up, above the lowest start.

    With ``to_tip`` the highest tip counts instead, whichever cylinder has it.
    """
    rise = F.col("length") * F.col("az")
    if to_tip:
        top = F.max(F.col("sz") + F.greatest(rise, F.lit(0.0)))
    else:
        top = F.max(F.struct("sz", F.greatest(rise, F.lit(0.0)).alias("rise")))
        top = top["sz"] + top["rise"]
    return cylinders.groupBy("tree_id").agg((top - F.min("sz")).alias("height"))


def breast_diameter(cylinders: DataFrame, trunk_only: bool = False) -> DataFrame:
    """Per tree: diameter in cm of the first cylinder (by number) whose summed length reaches breast height; with ``trunk_only`` of the trunk's, the last if none does."""
    rows = cylinders.where("branch_order = 0") if trunk_only else cylinders
    along = F.sum("length").over(Window.partitionBy("tree_id").orderBy("cyl").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.when(F.col("_along") >= BREAST_HEIGHT, F.col("cyl"))
    out = rows.withColumn("_along", along).groupBy("tree_id").agg(F.min_by("radius", reached).alias("_at"), F.max_by("radius", "cyl").alias("_last"), F.count(reached).alias("_n"))
    at = F.when(F.col("_n") > 0, F.col("_at"))
    return out.select("tree_id", ((F.coalesce(at, F.col("_last")) if trunk_only else at) * 200).alias("dbh_cm"))


def by_order(cylinders: DataFrame) -> DataFrame:
    """Per tree and branch order over 0: branches, volume, length, their shares of all branches in percent, and running sums."""
    o = cylinders.where("branch_order > 0").groupBy("tree_id", "branch_order").agg(
        F.countDistinct("branch").alias("n_branches"), F.sum(volume()).alias("volume"), F.sum("length").alias("length")
    )
    tree, up = Window.partitionBy("tree_id"), Window.partitionBy("tree_id").orderBy("branch_order").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: (F.col(c) / F.nullif(F.sum(c).over(tree), F.lit(0)) * 100).alias(f"{c}_pct")
    return o.select("*", share("n_branches"), share("volume"), share("length"), F.sum("volume").over(up).alias("volume_up_to"), F.sum("length").over(up).alias("length_up_to"))


def size_classes(cylinders: DataFrame, all_cylinders: bool = False) -> DataFrame:
    """Per tree and radius class: volume, length, shares in percent and running volume. Class i is (i - 1) < 200 r <= i, that is 1 cm of diameter.

    Branches only, unless ``all_cylinders``. Trees whose largest class is below 3 have classes of a tenth of it (``per_m`` 2000).
    """
    rows = cylinders if all_cylinders else cylinders.where("branch_order > 0")
    widest = F.max(F.ceil(F.col("radius") * 200)).over(Window.partitionBy("tree_id"))
    rows = rows.withColumn("per_m", F.when(widest < 3, 2000).otherwise(200))
    c = rows.withColumn("size_class", F.ceil(F.round(F.col("radius") * F.col("per_m"), 9))).groupBy("tree_id", "per_m", "size_class").agg(
        F.sum(volume()).alias("volume"), F.sum("length").alias("length")
    )
    tree, up = Window.partitionBy("tree_id"), Window.partitionBy("tree_id").orderBy("size_class").rowsBetween(Window.unboundedPreceding, 0)
    return c.select(
        "*", (F.col("volume") / F.sum("volume").over(tree) * 100).alias("volume_pct"), (F.col("length") / F.sum("length").over(tree) * 100).alias("length_pct"),
        F.sum("volume").over(up).alias("volume_up_to"),
    )


def taper(cylinders: DataFrame) -> DataFrame:
    """Per trunk cylinder: length so far, diameter in cm, volume so far and its share in percent."""
    up = Window.partitionBy("tree_id").orderBy("cyl").rowsBetween(Window.unboundedPreceding, 0)
    t = cylinders.where("branch_order = 0").select("tree_id", "cyl", F.sum("length").over(up).alias("along"), (F.col("radius") * 200).alias("diameter_cm"), F.sum(volume()).over(up).alias("volume_up_to"), volume().alias("_v"))
    return t.withColumn("volume_pct", F.col("volume_up_to") / F.sum("_v").over(Window.partitionBy("tree_id")) * 100).drop("_v")


def branch_table(cylinders: DataFrame) -> DataFrame:
    """Per branch: order, parent branch, diameter at its base, volume, area, length, angle to its parent cylinder, height, azimuth and zenith (degrees)."""
    base = F.struct("radius", "sz", "ax", "ay", "az", "parent", "cyl")
    b = cylinders.groupBy("tree_id", "branch", "branch_order").agg(
        F.min_by(base, "position").alias("_b"), F.sum(volume()).alias("volume"), F.sum(area()).alias("area"), F.sum("length").alias("length"),
        F.sort_array(F.collect_list("cyl")).alias("cylinders"),
    )
    ground = F.min("_b.sz").over(Window.partitionBy("tree_id"))
    up = cylinders.select("tree_id", F.col("cyl").alias("_cyl"), F.col("branch").alias("parent_branch"), *[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "az")])
    b = b.withColumn("_cyl", F.col("_b.parent")).join(up, ["tree_id", "_cyl"], "left")
    return b.select(
        "tree_id", "branch", "branch_order", "parent_branch", (F.col("_b.radius") * 2).alias("diameter"), "volume", "area", "length",
        angle_deg(vector("_b.ax", "_b.ay", "_b.az"), vector("_ax", "_ay", "_az")).alias("angle"), (F.col("_b.sz") - ground).alias("height"),
        F.degrees(F.atan2("_b.ay", "_b.ax")).alias("azimuth"), F.degrees(F.acos(F.least(F.greatest(F.col("_b.az"), F.lit(-1.0)), F.lit(1.0)))).alias("zenith"),
        F.col("_b.cyl").alias("first_cylinder"), "cylinders",
    )


def branch_children(branches: DataFrame) -> DataFrame:
    """Per branch: its children in order, and their number; branches without any have an empty list."""
    kids = branches.where(F.col("parent").isNotNull()).groupBy("tree_id", F.col("parent").alias("branch")).agg(F.array_sort(F.collect_set("branch")).alias("children"))
    return branches.select("tree_id", "branch").join(kids, ["tree_id", "branch"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>"))).withColumn("n_children", F.size("children"))


def attributes(cylinders: DataFrame, orders: int = 6) -> DataFrame:
    """One wide row per tree: totals, height, diameter, and branches, volume and length of each order up to ``orders``."""
    o = by_order(cylinders)
    pick = lambda k, c: F.coalesce(F.max(F.when(F.col("branch_order") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
    wide = o.groupBy("tree_id").agg(*[pick(k, c) for c in ("n_branches", "volume", "length") for k in range(1, orders + 1)])
    joined = totals(cylinders).join(height(cylinders), "tree_id").join(breast_diameter(cylinders), "tree_id").join(wide, "tree_id", "left")
    return joined.fillna(0)


def height_bins(cylinders: DataFrame, step: float = 1.0, longest: int | None = None) -> DataFrame:
    """Per tree and height bin above the lowest end: volume, area and length, shared out by how far each cylinder reaches into each bin.

    A level cylinder counts for the bin that it is in. With ``longest``, cylinders over more bins than that are left out.
    """
    tip = F.col("sz") + F.col("length") * F.col("az")
    c = cylinders.withColumn("_lo", F.least("sz", tip)).withColumn("_hi", F.greatest("sz", tip))
    ground = F.min("_lo").over(Window.partitionBy("tree_id"))
    c = c.withColumn("_a", (F.col("_lo") - ground) / step).withColumn("_b", (F.col("_hi") - ground) / step)
    if longest is not None:
        c = c.where(F.floor("_b") - F.floor("_a") < longest)
    c = c.withColumn("bin", F.explode(F.sequence(F.floor("_a"), F.floor("_b"))))
    inside = F.least("_b", F.col("bin") + 1) - F.greatest("_a", F.col("bin"))
    share = F.when(F.col("_b") > F.col("_a"), inside / (F.col("_b") - F.col("_a"))).otherwise(1.0)
    return c.groupBy("tree_id", "bin").agg(F.sum(volume() * share).alias("volume"), F.sum(area() * share).alias("area"), F.sum(F.col("length") * share).alias("length"))


def monotone_radii(cylinders: DataFrame) -> DataFrame:
    """Cylinders with radii that never grow along a branch: the least so far."""
    return cylinders.withColumn("radius", F.min("radius").over(Window.partitionBy("tree_id", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))


def straight_prefix(cylinders: DataFrame, thin: float = 0.333, bend: float = 0.97) -> DataFrame:
    """The trunk's cylinders up to the first that is thinner than ``thin`` of the first or bends away from the one before."""
    line = Window.partitionBy("tree_id").orderBy("cyl")
    first = F.first("radius").over(line.rowsBetween(Window.unboundedPreceding, 0))
    along = sum((F.col(a) * F.lag(a).over(line) for a in ("ax", "ay", "az")), F.lit(0.0))
    ok = (F.col("radius") > first * thin) & F.coalesce(along > bend, F.lit(True))
    t = cylinders.where("branch_order = 0").withColumn("_ok", ok.cast("int"))
    return t.withColumn("_ok", F.min("_ok").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("_ok = 1").drop("_ok")


def distribution(rows: DataFrame, by: list[str], bin_: Column, values: dict[str, Column]) -> DataFrame:
    """Sums by bin, with all bins from 0 to the largest of each group present."""
    found = rows.withColumn("bin", bin_.cast("long")).groupBy(*by, "bin").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    all_bins = found.groupBy(*by).agg(F.max("bin").alias("_top")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias("bin"))
    return all_bins.join(found, [*by, "bin"], "left").fillna(0, [*values])
