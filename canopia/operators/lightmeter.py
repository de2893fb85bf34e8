"""Light-meter readings: nearest readings above canopy, gap fractions, and plant-area indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the instrument: path length and weight of its five rings.
DISTANCES = (1.008, 1.087, 1.270, 1.662, 2.670)
WEIGHTS = (0.0461, 0.1431, 0.2085, 0.2655, 0.3368)


def nearest_reading(readings: DataFrame, day: str = "day", at: str = "micros", span: int = 900_000_000) -> DataFrame:
    """Each B reading with the A reading of its day that is nearest in time; of two equally near the later.

    Sorted within spans of time (in units of ``at``), without a join of readings: for every B the last A before it and the first from it on. Where
    its own span has none, that of the nearest span that has comes in, from a table of spans. A day without A has no match and drops out.
    """
    a = F.when(F.col("kind") == "A", F.struct(F.col(at).alias("at"), F.col("value"), F.col("seq")))
    r = readings.withColumn("_span", F.floor(F.col(at) / span))
    order = Window.partitionBy(day, "_span").orderBy(at, F.when(F.col("kind") == "A", 0).otherwise(1), "seq")
    later = Window.partitionBy(day, "_span").orderBy(at, F.when(F.col("kind") == "A", 1).otherwise(0), "seq")
    key = F.when(F.col("kind") == "A", F.struct(F.col(at), F.col("seq")))
    ends = r.groupBy(day, "_span").agg(F.max_by(a, key).alias("_last"), F.min_by(a, key).alias("_first"))
    by_day = Window.partitionBy(day).orderBy("_span")
    ends = ends.select(
        day, "_span", F.last("_last", True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", True).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("_later")
    )
    r = r.withColumn("_before", F.last(a, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_from", F.first(a, True).over(later.rowsBetween(0, Window.unboundedFollowing))).where("kind = 'B'").join(ends, [day, "_span"])
    r = r.withColumns({"_before": F.coalesce("_before", "_earlier"), "_from": F.coalesce("_from", "_later")})
    gap_before, gap_from = F.col(at) - F.col("_before.at"), F.col("_from.at") - F.col(at)
    # An A at the very time of a B stands in both; the one from it on is then at distance 0 as well.
    near = F.when(F.col("_from").isNull() | (gap_before < gap_from), F.col("_before")).otherwise(F.col("_from"))
    return r.withColumn("_near", near).where(F.col("_near").isNotNull()).select(
        day, "seq", F.col(at).alias("b_micros"), F.col("_near.at").alias("a_micros"), F.col("value").alias("b_value"), F.col("_near.value").alias("a_value")
    )


def gap_statistics(gaps: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation and its percentage for each ring."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.avg(c).alias(f"{c}_mean"), sd.alias(f"{c}_sd"), (sd / F.nullif(F.avg(c), F.lit(0.0)) * 100).alias(f"{c}_sd_pct")]
    return gaps.groupBy(*by).agg(*out)


def _index(values: list[Column], distances: tuple, weights: tuple) -> Column:
    total = F.lit(0.0)
    for v, d, w in zip(values, distances, weights, strict=True):
        total = total - F.ln(v) / d * w
    return total * 2


def effective_area_index(gaps: DataFrame, by: list[str], columns: list[str], distances: tuple = DISTANCES, weights: tuple = WEIGHTS) -> DataFrame:
    """Logarithm of the mean gap fraction of each ring, summed over the rings (clumping is left in)."""
    means = gaps.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(*by, _index([F.col(c) for c in columns], distances, weights).alias("paie"))


def area_index(gaps: DataFrame, by: list[str], columns: list[str], distances: tuple = DISTANCES, weights: tuple = WEIGHTS) -> DataFrame:
    """Mean over the measurements of each one's own sum over the rings."""
    return gaps.groupBy(*by).agg(F.avg(_index([F.col(c) for c in columns], distances, weights)).alias("pai"), F.count(F.lit(1)).alias("n"))
