"""Ties and odd trees on which queries differed from their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from canopia.functions.rounding import by_magnitude
from canopia.operators import crown, features


def test_magnitudes_in_both_engines(spark):
    """halves in decimals that are no halves in binary."""
    values = [k / 100 + 0.05 for k in range(1000, 9000, 10)] + [k / 1000 + 0.005 for k in range(1000, 9000, 10)] + [k / 1000 + 0.0005 for k in range(0, 900)] + [100.5, 101.5, 11.45, -11.45, 0.0, -0.0001]
    got = [r.v for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(by_magnitude(F.col("x")).alias("v")).collect()]
    sql = "CASE WHEN abs(v) > 100 THEN round(v, 0) WHEN abs(v) > 10 THEN round(v, 1) WHEN abs(v) > 1 THEN round(v, 2) ELSE round(v, 3) END + 0.0"
    assert got == [duckdb.execute(f"SELECT {sql} FROM (SELECT CAST(? AS DOUBLE) AS v)", [v]).fetchone()[0] for v in values]


def test_tree_of_one_height_has_no_thirds(spark):
    """all starts at one height."""
    rows = [(1, 1, 0.1, 1.0, 0.0, 0.0, 2.0), (1, 2, 0.1, 1.0, 1.0, 0.0, 2.0), (2, 1, 0.1, 1.0, 0.0, 0.0, 0.0), (2, 2, 0.1, 1.0, 1.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "tree_id long, cyl long, radius double, length double, sx double, sy double, sz double")
    assert sorted((r.tree_id, r.third) for r in features.volume_radius(df).collect()) == [(2, 0), (2, 2)]


@pytest.mark.parametrize("tiny", [1e-19, 0.0, -1e-19])
def test_straight_behind_the_centre(spark, tiny):
    """a direction of pi is one of -pi."""
    row = spark.createDataFrame([(-1.0, tiny)], "x double, y double").select(crown.sector_around(F.col("x"), F.col("y"), 36).alias("s")).first()
    assert row.s == 0
