"""Stem inventory of point clouds: a slice at breast height, a circle through it, and the height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.functions.rounding import half_even


def heights(points: DataFrame) -> DataFrame:
    return points.groupBy("tree_id").agg(F.min("z").alias("z_min"), (F.max("z") - F.min("z")).alias("height"))


def breast_slice(points: DataFrame, breast: float = 1.3, half: float = 0.03) -> DataFrame:
    """Points in the open band around breast height above the lowest point; of trees not that tall, the band 8 to 2 cm below the top."""
    p = points.join(heights(points), "tree_id")
    above = F.col("z") - F.col("z_min")
    tall = F.col("height") > breast
    low = F.when(tall, F.lit(breast - half)).otherwise(F.col("height") - 0.08)
    high = F.when(tall, F.lit(breast + half)).otherwise(F.col("height") - 0.02)
    return p.where((above > low) & (above < high)).drop("z_min")


def circle_fit(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """Per group: centre ``xc, yc``, ``radius`` (mean distance from it) and ``n`` of the least-squares circle; null where the points do not fix one.

    Sums of moments about the mean, solved by Cramer's rule: three partial aggregations, no group is ever gathered.
    """
    mean = points.groupBy(by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = points.select(by, "x", "y").join(mean, by).withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    u, v = F.col("u"), F.col("v")
    m = c.groupBy(by).agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * u * u + u * v * v).alias("ru"), F.sum(v * v * v + v * u * u).alias("rv"),
        F.max("mx").alias("mx"), F.max("my").alias("my"), F.count(F.lit(1)).alias("n"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    det = F.when(F.abs(det) > 1e-18, det)
    centre = m.select(
        by, "n", (F.col("mx") + (F.col("ru") * F.col("vv") - F.col("rv") * F.col("uv")) / (2 * det)).alias("xc"),
        (F.col("my") + (F.col("rv") * F.col("uu") - F.col("ru") * F.col("uv")) / (2 * det)).alias("yc"),
    )
    far = F.sqrt(F.pow(F.col("x") - F.col("xc"), F.lit(2)) + F.pow(F.col("y") - F.col("yc"), F.lit(2)))
    radius = points.select(by, "x", "y").join(centre, by).groupBy(by).agg(F.avg(far).alias("radius"))
    return centre.join(radius, by)


def inventory(points: DataFrame, digits: int = 2) -> DataFrame:
    """Per tree: ``xc, yc, dbh_cm, height``; trees without a circle keep their height."""
    circle = circle_fit(breast_slice(points))
    return heights(points).join(circle, "tree_id", "left").select(
        "tree_id", half_even(F.col("xc"), digits).alias("xc"), half_even(F.col("yc"), digits).alias("yc"), half_even(F.col("radius") * 200, digits).alias("dbh_cm"),
        half_even(F.col("height"), digits).alias("height"),
    )


def circle_outline(circles: DataFrame, n: int = 201) -> DataFrame:
    """``n`` points on each circle, the last on the first."""
    angle = F.col("k") * (2 * 3.141592653589793 / (n - 1))
    return circles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "tree_id", "k", (F.col("xc") + F.col("radius") * F.cos(angle)).alias("x"), (F.col("yc") + F.col("radius") * F.sin(angle)).alias("y")
    )
