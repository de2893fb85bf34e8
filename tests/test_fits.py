"""Circles and cylinders fitted step by step for all groups at once, against fits of one group at a time."""

import math

import numpy as np
import pytest

from canopia.operators import iterated_fits
from canopia.operators.fitting import fit_cylinder, frame

POINTS = "g long, x double, y double, z double"


def ring(r, n, x, y, radius, noise=0.002, part=2 * math.pi):
    a = r.uniform(0, part, n)
    return np.column_stack([x + radius * np.cos(a), y + radius * np.sin(a)]) + r.normal(0, noise, (n, 2))


def circle(p):
    """Gauss-Newton for one circle."""
    x, y = p.mean(0)
    radius = np.hypot(*(p - [x, y]).T).mean()
    for _ in range(300):
        d = p - [x, y]
        far = np.hypot(*d.T)
        step = np.linalg.lstsq(-np.column_stack([d / far[:, None], np.ones(len(p))]), radius - far, rcond=None)[0]
        x, y, radius = x + step[0], y + step[1], radius + step[2]
    return x, y, radius


def test_circles_are_those_of_one_at_a_time(spark):
    r = np.random.default_rng(1)
    sets = {1: ring(r, 200, 3, -2, 0.15), 2: ring(r, 60, 0, 0, 1.5, 0.05), 3: ring(r, 80, 100, 50, 0.4, 0.002, 2.2), 4: ring(r, 3, 0, 0, 1.0, 0), 5: ring(r, 2, 0, 0, 1.0), 7: np.zeros((5, 2))}
    df = spark.createDataFrame([(g, *map(float, x), 0.0) for g, p in sets.items() for x in p], POINTS)
    got = {x.g: x for x in iterated_fits.fit_circles(df, ["g"]).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    for g in (1, 2, 3, 4):
        assert got[g].settled and got[g].reliable
        assert (got[g].xc, got[g].yc, got[g].radius) == pytest.approx(circle(sets[g]), abs=1e-6)
        assert got[g].mean_dist == pytest.approx(np.abs(np.hypot(*(sets[g] - [got[g].xc, got[g].yc]).T) - got[g].radius).mean())
    assert not got[7].reliable
    assert iterated_fits.fit_circles(df.limit(0), ["g"]).collect() == []


def test_a_bad_start_is_damped_and_comes_back(spark):
    r = np.random.default_rng(2)
    p = ring(r, 150, 0, 0, 1.0, 0.01)
    df = spark.createDataFrame([(1, *map(float, x), 0.0) for x in p], POINTS)
    starts = spark.createDataFrame([(1, [0.9, 0.9, 0.1])], "g long, at array<double>")
    got = iterated_fits.fit_circles(df, ["g"], starts).first()
    assert got.settled and (got.xc, got.yc, got.radius) == pytest.approx(circle(p), abs=1e-6)
    # The steps themselves: squares that rise call for a shorter step from the same place.
    state = {"at": [0.0], "trial": [1.0], "step": [1.0], "slope": [-2.0], "scale": [1.0], "f0": 1.0, "foretold": -2.0, "steps": 1, "tested": True, "done": False, "settled": False, "reliable": True}
    after = iterated_fits.Progress(1, state, lambda a, s: a + s).after(np.array([1.0, 0.0, 4.0]))
    assert after["at"] == [0.0] and after["trial"] == pytest.approx([1 / (2 * (1 + 1.5))]) and not after["tested"]


def tube(r, base, axis, radius, length, n, noise=0.002):
    t, h = r.uniform(0, 2 * math.pi, n), r.uniform(0, length, n)
    u, v, w = frame(axis)
    return base + np.outer(h, w) + radius * (np.outer(np.cos(t), u) + np.outer(np.sin(t), v)) + r.normal(0, noise, (n, 3))


def test_cylinders_are_those_of_one_at_a_time(spark):
    r = np.random.default_rng(3)
    sets = {}
    for g in range(6):
        axis = r.normal(size=3)
        sets[g] = tube(r, r.normal(size=3) * 5, axis / np.linalg.norm(axis), r.uniform(0.02, 0.3), r.uniform(0.8, 2), 250)
    sets[10] = r.normal(size=(4, 3))
    sets[11] = np.outer(np.arange(12.0), [1, 1, 0])
    df = spark.createDataFrame([(g, *map(float, x)) for g, p in sets.items() for x in p], POINTS)
    got = {x.g: x for x in iterated_fits.fit_cylinders(df, ["g"]).collect()}
    assert set(got) == {*range(6), 11}
    for g in range(6):
        want = fit_cylinder(sets[g])
        assert got[g].reliable and want["reliable"] and not got[g].refitted and got[g].n_points == 250
        assert got[g].radius == pytest.approx(want["radius"], abs=1e-6) and got[g].length == pytest.approx(want["length"], abs=1e-5) and got[g].mean_dist == pytest.approx(want["mean_dist"], abs=1e-6)
        assert abs(np.array([got[g].ax, got[g].ay, got[g].az]) @ want["axis"]) == pytest.approx(1, abs=1e-9)
    assert not got[11].reliable
    assert iterated_fits.fit_cylinders(df.limit(0), ["g"]).collect() == []


def test_a_grown_radius_is_looked_at_again(spark):
    """A rough stem of 0.35 m fitted from a start of 0.2: the radius grows by over half and points lie far off, so the nearer half is fitted again."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(1, *map(float, x)) for x in tube(r, np.zeros(3), np.array([0, 0, 1.0]), 0.35, 1.0, 200, 0.06)], POINTS)
    starts = spark.createDataFrame([(1, [0.0, 0.0, 0.5, 0.0, 0.0, 1.0, 0.2])], "g long, at array<double>")
    got = iterated_fits.fit_cylinders(df, ["g"], starts).first()
    assert got.refitted and got.reliable and 50 <= got.n_points < 200 and got.radius == pytest.approx(0.35, rel=0.1) and got.mean_dist < 0.05
