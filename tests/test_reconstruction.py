"""A synthetic tree with known cylinders, from points to branches."""

import math

import numpy as np
import pytest

from canopia.operators import segmentation, spatial
from canopia.operators.fitting import fit_cylinder, frame


def tube(r, base, axis, radius, length, n):
    t, h = r.uniform(0, 2 * math.pi, n), r.uniform(0, length, n)
    u, v, w = frame(axis)
    return base + np.outer(h, w) + radius * (np.outer(np.cos(t), u) + np.outer(np.sin(t), v)) + r.normal(0, 0.002, (n, 3))


@pytest.mark.parametrize("seed", range(5))
def test_fit_finds_a_cylinder(seed):
    r = np.random.default_rng(seed)
    axis = r.normal(size=3)
    axis /= np.linalg.norm(axis)
    p = tube(r, r.normal(size=3), axis, 0.15, 0.8, 400)
    f = fit_cylinder(p)
    assert f["reliable"] and f["radius"] == pytest.approx(0.15, rel=0.02) and abs(f["axis"] @ axis) > 0.999 and f["length"] == pytest.approx(0.8, rel=0.05)
    half = p[(p - p.mean(0)) @ frame(axis)[0] > 0]
    assert fit_cylinder(half, axis)["radius"] == pytest.approx(0.15, rel=0.1)
    assert not fit_cylinder(p[:4])["reliable"]


def test_tree_from_points(spark):
    r = np.random.default_rng(1)
    parts = [tube(r, np.zeros(3), np.array([0, 0, 1.0]), 0.12, 5.0, 6000)]
    for k in range(3):
        a = np.array([math.cos(2.1 * k), math.sin(2.1 * k), 1.0]) / math.sqrt(2)
        base = np.array([0, 0, 2.0 + k * 0.8]) + 0.12 * np.array([a[0], a[1], 0]) / math.hypot(a[0], a[1])
        parts.append(tube(r, base, a, 0.03, 1.5, 900))
    p = np.concatenate(parts)
    points = spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(p)], "tree_id long, pid long, x double, y double, z double")
    members = spatial.cover(points, 0.1, 0.12, 2, seed=1)[1].cache()
    sets = segmentation.segments(points, members, spatial.cover_neighbours(points, members, 0.12), base_band=0.1)
    sets = sets.cache()
    assert sets.count() > 0.95 * members.select("centre").distinct().count()
    c = segmentation.cylinders(points, members, sets, layers=4, least=30).toPandas()
    trunk = c[(c.branch_order == 0) & c.reliable]
    assert trunk.radius.median() == pytest.approx(0.12, rel=0.15)
    first = c[c.branch_order == 1].groupby("segment").agg(n=("n_points", "sum"))
    assert (first.n > 300).sum() == 3
    volume = (math.pi * trunk.radius**2 * trunk.length).sum()
    assert volume == pytest.approx(math.pi * 0.12**2 * 5, rel=0.35)  # regions overlap where layers meet
