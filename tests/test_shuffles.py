"""Queries over whole trees move their rows once: what is done to a tree stays where the tree is."""

import pytest
from pyspark.sql import functions as F

from canopia.operators import crown
from canopia.operators import distributions as dist
from canopia.plans import catalog, shared
from canopia.sources import tables


def exchanges(df) -> int:
    return sum("Exchange" in x and "Broadcast" not in x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n"))


# F2 to F6, F8 to F11, F31, F32, F35, F37 to F39
@pytest.mark.parametrize(("name", "most"), [
    ("tree_scalars", 8), ("geo17_crown_diameters", 3), ("fea4_all_interval_sums", 8), ("fea6_all_quantile_places", 4), ("fea7_all_reference_differences", 0), ("fea8_mean_ratios", 2), ("fea9_both_azimuths_against_uniform", 0),
])
def test_few_shuffles(spark, small_dir, name, most):
    assert exchanges(catalog.queries()[name](spark, small_dir)) <= most


def test_settings_hold_only_inside(spark):
    keys = [shared.CLEAN, "spark.sql.requireAllClusterKeysForCoPartition"]
    before = [spark.conf.get(k) for k in keys]
    t = shared.materialize_by(spark.range(100).withColumn("v", F.col("id") * 2), "id", "test")
    assert [spark.conf.get(k) for k in keys] == before and exchanges(t.groupBy("id").agg(F.sum("v"))) == 0
    assert {(r.id, r.v) for r in t.collect()} == {(k, 2 * k) for k in range(100)}


def test_branch_without_lines_has_no_children(spark, tmp_path):
    """A first cylinder's parent is that of the branch above; none if that has no lines."""
    orders = [(k, 7) for k in range(10, 17)]
    lines = [(o, n, 1, 1, 2.0, 100.0, 0.01, 0.02) for o, _ in orders if o != 12 for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.branch, r.position): (r.cyl, r.parent) for r in tables.cylinders(spark, str(tmp_path)).collect()}
    first = {b: got[b, 1][1] for b in (10, 11, 13, 14, 15, 16)}
    assert first == {10: None, 11: 1, 13: 3, 14: 3, 15: None, 16: None} and all(got[b, 2] == (got[b, 1][0] + 1, got[b, 1][0]) for b in first)


def test_hull_in_batches(spark):
    """Corners are the same however many batches a group comes in, repeated places and small groups included."""
    import numpy as np

    rng = np.random.default_rng(5)
    clouds = {1: rng.normal(size=(4000, 2)), 2: rng.uniform(size=(3, 2)), 3: np.repeat([[1.0, 2.0]], 40, 0), 4: np.stack([np.arange(50.0), np.arange(50.0)], 1)}
    df = spark.createDataFrame([(t, *map(float, p)) for t, c in clouds.items() for p in c], "tree_id long, x double, y double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        rows = crown.hull_corners(df, ["tree_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, c in clouds.items():
        assert sorted((r.x, r.y) for r in rows if r.tree_id == t) == sorted(map(tuple, crown.corners(c).tolist())), t


def test_ratios_over_means_beyond_a_least(spark):
    s = spark.createDataFrame([(1, 0, "p", 2.0), (1, 0, "q", 0.001), (1, 1, "p", 3.0)], "tree_id long, orders int, column string, mean double")
    assert [(r.a, r.b, r.value) for r in dist.mean_ratios(s, 0.01).collect()] == [("q", "p", 0.0005)]
