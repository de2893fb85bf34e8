"""Rasters as one row per pixel and band: statistics, sums over images, contrast stretches, turning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.groupBy(*by).agg(
        F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.countDistinct("value").alias("n_distinct")
    )


def sum_images(pixels: DataFrame, images: int | None = None) -> DataFrame:
    """Sum over the first ``images`` images (by number; all if unset) of each pixel and band. Images must agree in size: ``n_images`` tells where they do not."""
    if images is not None:
        first = pixels.select("image").distinct().orderBy("image").limit(images)
        pixels = pixels.join(F.broadcast(first), "image", "left_semi")
    return pixels.groupBy("band", "row", "col").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_images"))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image").agg(F.countDistinct("band").alias("bands"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def stretch(pixels: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Values between two percentiles of their group as 0 to 1, clamped."""
    edge = pixels.groupBy(*by).agg(F.percentile("value", F.lit(low)).alias("_lo"), F.percentile("value", F.lit(high)).alias("_hi"))
    scaled = (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return pixels.join(edge, by).withColumn("value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def to_bytes(pixels: DataFrame, by: list[str], high: float = 0.99) -> DataFrame:
    """Values as whole numbers from 0 to 255, the percentile ``high`` of the brightest band of each pixel becoming 255; zeros are full."""
    brightest = pixels.groupBy(*by, "row", "col").agg(F.max("value").alias("_v"))
    top = brightest.groupBy(*by).agg(F.percentile("_v", F.lit(high)).alias("_top"))
    share = F.col("value") / F.nullif(F.col("_top"), F.lit(0.0))
    share = F.when((share == 0) | (share > 1), F.lit(1.0)).otherwise(share)
    return pixels.join(top, by).withColumn("byte", F.floor(share * 255).cast("long")).drop("_top")


def turned(pixels: DataFrame, rows: int) -> DataFrame:
    """Transposed, then turned by three quarters: the same columns with the rows in reverse order."""
    return pixels.withColumn("row", F.lit(rows - 1) - F.col("row"))
