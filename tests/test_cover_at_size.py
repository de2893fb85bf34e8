"""Cover sets of dense clouds without all their pairs."""

import numpy as np
from pyspark.sql import functions as F

from canopia.operators import spatial


def test_exploded_points_are_not_broadcast(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.01, 0.0, 0.0)], "tree_id long, pid long, x double, y double, z double")
    pairs = spatial.radius_pairs(p, p, 0.05)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 4


def test_dense_cloud(spark):
    """Three thousand points within a few radii, some without a place, against the walk."""
    rng = np.random.default_rng(8)
    at = rng.normal(0, 0.05, (3000, 3))
    rows = [(1, k, *map(float, x)) for k, x in enumerate(at)] + [(1, 5000, float("nan"), 0.0, 0.0), (1, 5001, None, 0.0, 0.0), (1, 5002, 9.0, 9.0, 9.0)]
    p = spark.createDataFrame(rows, "tree_id long, pid long, x double, y double, z double").repartition(4)
    for nmin, alone in ((1, [5002]), (3, [])):
        near = lambda k, r: np.sqrt(((at - at[k]) ** 2).sum(1)) < r
        walk = []
        for k in range(3000):
            if near(k, 0.06).sum() >= nmin and not any(np.sqrt(((at[k] - at[c]) ** 2).sum()) < 0.05 for c in walk):
                walk.append(k)
        assert sorted(r.pid for r in spatial.cover(p, 0.05, 0.06, nmin)[0].select(F.col("pid")).collect()) == walk + alone
