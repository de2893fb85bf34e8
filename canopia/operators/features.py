"""Structural features of trees from their branches, cylinders and scalar attributes, as long tables (tree, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lower and upper relative heights between which the share of bare branches is counted.
SHEDDING = [(i / 5, j / 5) for i in range(5) for j in range(i + 1, 6)]


def stem_branch_angle(branches: DataFrame) -> DataFrame:
    """Median angle of the first-order branches."""
    return branches.where("branch_order = 1").groupBy("tree_id").agg(F.median("angle").alias("value"))


def largest_radius_ratio(branches: DataFrame, n: int = 10) -> DataFrame:
    """Mean ratio of radius to the parent's at the ``n`` thickest first-order branches; ties by branch."""
    w = Window.partitionBy("tree_id").orderBy(F.desc("radius"), "branch")
    return branches.where("branch_order = 1").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy("tree_id").agg(F.avg(F.col("radius") / F.col("parent_radius")).alias("value"))


def neighbour_gap(branches: DataFrame, reach: float = 0.5) -> DataFrame:
    """Mean height difference of all pairs of first-order branches within ``reach``; a branch without another there counts once, with ``reach``.

    A range frame over the heights: sums and counts below and above each branch, without pairs.
    """
    h = F.col("height")
    over = lambda f, frame: F.expr(f"{f} OVER (PARTITION BY tree_id ORDER BY height RANGE BETWEEN {frame})")
    below, above = f"{reach}D PRECEDING AND CURRENT ROW", f"CURRENT ROW AND {reach}D FOLLOWING"
    b = branches.where("branch_order = 1").select(
        "tree_id", "branch", "height", over("count(1)", below).alias("_nb"), over("sum(height)", below).alias("_sb"), over("count(1)", above).alias("_na"), over("sum(height)", above).alias("_sa"),
        F.count(F.lit(1)).over(Window.partitionBy("tree_id", "height")).alias("_same"),
    )
    others = F.col("_nb") + F.col("_na") - F.col("_same") - 1
    total = (F.col("_nb") * h - F.col("_sb")) + (F.col("_sa") - F.col("_na") * h)
    return b.groupBy("tree_id").agg((F.sum(F.when(others > 0, total).otherwise(F.lit(reach))) / F.sum(F.greatest(others, F.lit(1)))).alias("value"))


def height_clusters(branches: DataFrame, width: float = 0.4) -> DataFrame:
    """Mean size of groups of first-order branches: going up, a group takes all within ``width`` of its first.

    Where a group starts depends on the one before, so the walk is a fold over each tree's own sorted heights.
    """
    h = branches.where("branch_order = 1").groupBy("tree_id").agg(F.sort_array(F.collect_list("height")).alias("_h"))
    start = F.struct(F.lit(float("-inf")).alias("first"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.when(x - a["first"] > width, x).otherwise(a["first"]).alias("first"), (a["n"] + F.when(x - a["first"] > width, 1).otherwise(0)).alias("n"))
    return h.select("tree_id", (F.size("_h") / F.aggregate("_h", start, step, lambda a: a["n"])).alias("value"))


def bare_shares(branches: DataFrame, intervals: list[tuple[float, float]] = SHEDDING) -> DataFrame:
    """``tree_id, low, high, value``: share of first-order branches without children between two relative heights; null without branches there."""
    parents = branches.select("tree_id", F.col("parent_branch").alias("branch")).where(F.col("branch").isNotNull()).distinct().withColumn("_has", F.lit(1))
    top = branches.groupBy("tree_id").agg(F.max("height").alias("_top"))
    b = branches.where("branch_order = 1").join(parents, ["tree_id", "branch"], "left").join(top, "tree_id").withColumn("_rel", F.round(F.col("height") / F.nullif(F.col("_top"), F.lit(0.0)), 9))
    spans = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b_).alias("high")) for a, b_ in intervals])
    each = b.select("*", F.inline(spans))
    inside = (F.col("_rel") >= F.col("low")) & (F.col("_rel") < F.col("high"))
    return each.groupBy("tree_id", "low", "high").agg(F.avg(F.when(inside, F.when(F.col("_has").isNull(), 1.0).otherwise(0.0))).alias("value"))


def pair_ratios(scalars: DataFrame, names: list[str], by: str = "tree_id") -> DataFrame:
    """``by, feature, value``: every scalar and every ordered ratio of two; ratios by zero are 0. Made within each row."""
    one = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    two = [F.struct(F.lit(f"{a}/{b}").alias("feature"), F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.nullif(F.col(b), F.lit(0))).cast("double").alias("value")) for a in names for b in names]
    return scalars.select(by, F.inline(F.array(*one, *two)))


def interval_sums(bins: DataFrame, parts: int = 5) -> DataFrame:
    """``tree_id, low, high, value``: sums of a distribution (tree_id, bin, value) over all intervals of its ``parts`` equal parts, as shares."""
    top = bins.groupBy("tree_id").agg((F.max("bin") + 1).alias("_n"), F.sum("value").alias("_t"))
    b = bins.join(top, "tree_id").withColumn("_part", F.floor(F.col("bin") * parts / F.col("_n")))
    spans = F.array(*[F.struct(F.lit(i).alias("low"), F.lit(j).alias("high")) for i in range(parts) for j in range(i + 1, parts + 1)])
    each = b.select("*", F.inline(spans)).where((F.col("_part") >= F.col("low")) & (F.col("_part") < F.col("high")))
    return each.groupBy("tree_id", "low", "high").agg((F.sum("value") / F.nullif(F.max("_t"), F.lit(0.0))).alias("value"))


def reference_differences(bins: DataFrame, kinds: tuple[str, ...] = ("uniform", "triangle")) -> DataFrame:
    """``tree_id, kind, mean_diff, max_diff``: a distribution's shares against reference densities over as many bins."""
    top = bins.groupBy("tree_id").agg((F.max("bin") + 1).alias("_n"), F.sum("value").alias("_t"))
    middle = (F.col("bin") + 0.5) / F.col("_n")
    density = {"uniform": F.lit(1.0) / F.col("_n"), "triangle": F.lit(2.0) * (F.lit(1.0) - F.abs(middle * 2 - 1)) / F.col("_n")}
    b = bins.join(top, "tree_id").withColumn("_share", F.col("value") / F.nullif(F.col("_t"), F.lit(0.0)))
    each = b.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), density[k].alias("_d")) for k in kinds])))
    diff = F.abs(F.col("_share") - F.col("_d"))
    return each.groupBy("tree_id", "kind").agg(F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"))


def quantile_bins(bins: DataFrame, steps: int = 19) -> DataFrame:
    """``tree_id, pct, value``: relative place of the first bin whose running share passes 5, 10 .. 95 percent."""
    up = Window.partitionBy("tree_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree_id")
    b = bins.withColumn("_c", F.sum("value").over(up) / F.nullif(F.sum("value").over(whole), F.lit(0.0))).withColumn("_n", F.max("bin").over(whole) + 1)
    each = b.withColumn("pct", F.explode(F.sequence(F.lit(1), F.lit(steps)))).where(F.round("_c", 9) > F.col("pct") / (steps + 1))
    return each.groupBy("tree_id", "pct").agg((F.min("bin") / F.max("_n")).alias("value"))


def branch_statistics(branches: DataFrame, columns: list[str]) -> DataFrame:
    """``tree_id, orders, column, median, mean, least, most, mean_of_most``: over all branches (orders -1) and those of orders 1 to 3, by grouping sets of one pass."""
    long = branches.where("branch_order > 0").unpivot(["tree_id", "branch_order"], columns, "column", "value")
    sets = long.withColumn("orders", F.explode(F.array(F.lit(-1), F.when(F.col("branch_order") <= 3, F.col("branch_order"))))).where(F.col("orders").isNotNull())
    return sets.groupBy("tree_id", "orders", "column").agg(
        F.median("value").alias("median"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
        (F.avg("value") / F.nullif(F.max("value"), F.lit(0.0))).alias("mean_of_most"),
    )


def volume_radius(cylinders: DataFrame, share: float = 0.9, thirds: int = 3) -> DataFrame:
    """``tree_id, third, value``: distance from the tree's foot within which ``share`` of a height third's volume lies."""
    foot = cylinders.groupBy("tree_id").agg(F.min_by("sx", "cyl").alias("_x"), F.min_by("sy", "cyl").alias("_y"), F.min("sz").alias("_z0"), F.max("sz").alias("_z1"))
    v = F.col("radius") * F.col("radius") * F.col("length")
    c = cylinders.join(foot.where("_z1 > _z0"), "tree_id").select(  # a tree of one height has no thirds
        "tree_id", "cyl", F.sqrt(F.pow(F.col("sx") - F.col("_x"), F.lit(2)) + F.pow(F.col("sy") - F.col("_y"), F.lit(2))).alias("_d"), v.alias("_v"),
        F.least(F.floor((F.col("sz") - F.col("_z0")) / F.nullif(F.col("_z1") - F.col("_z0"), F.lit(0.0)) * thirds), F.lit(thirds - 1)).alias("third"),
    )
    g = Window.partitionBy("tree_id", "third")
    c = c.withColumn("_c", F.sum("_v").over(g.orderBy("_d", "cyl").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_v").over(g))
    return c.where(F.round("_c", 9) >= share).groupBy("tree_id", "third").agg(F.min("_d").alias("value"))


def crown_evenness(cylinders: DataFrame, sectors: int = 8) -> DataFrame:
    """Lowest over highest of the lowest branch heights in the sectors around the stem."""
    ground = cylinders.groupBy("tree_id").agg(F.min("sz").alias("_z"))
    sector = F.floor((F.atan2("sy", "sx") + 3.141592653589793) / (2 * 3.141592653589793) * sectors)
    low = cylinders.where("branch_order > 0").join(ground, "tree_id").groupBy("tree_id", F.least(sector, F.lit(sectors - 1)).alias("_s")).agg(F.min(F.col("sz") - F.col("_z")).alias("_h"))
    return low.groupBy("tree_id").agg((F.min("_h") / F.nullif(F.max("_h"), F.lit(0.0))).alias("value"))
