"""Cylinder regions against a walk along one segment at a time."""

import math

import numpy as np
import pytest

from canopia.operators import regions

STEP = 1e-4


def walk_regions(layers, centres, stem, length=3.0):
    """Regions of one segment by loops: lists of point ids, and shapes; ``layers`` are lists of (pid, place), ``centres`` their centres' places."""
    nl = len(layers)
    ids = lambda a, b: [p for layer in layers[a - 1 : b] for p, _ in layer]
    xyz = lambda a, b: np.array([x for layer in layers[a - 1 : b] for _, x in layer])
    mean = lambda a, b: xyz(a, b).mean(0)
    n_points = sum(map(len, layers))
    if nl < 2 or n_points <= 20 or n_points <= len(layers[0]) or sum(map(len, centres)) <= 2:
        return []
    if nl > 4:  # the first four layers are one where the first is at neither end
        c = np.concatenate([np.array(x) for x in centres[:5]])
        way = np.linalg.eigh(np.cov(c.T))[1][:, 2]
        along, base = np.round(c @ way, 9), np.round(np.array(centres[0]) @ way, 9)
        if along.min() != base.min() and along.max() != base.max():
            layers, centres = [sum(layers[:4], []), *layers[4:]], [sum(centres[:4], []), *centres[4:]]
            nl -= 3

    def axis(b, t):
        v = t - b
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else np.array([0.0, 0, 1])

    if nl <= 3:
        a, p = axis(np.mean(centres[0], 0), np.mean(centres[-1], 0)), xyz(2, nl)
        m = p.mean(0)
        h = (p - m) @ a
        q = np.round(np.linalg.norm(p - m - np.outer(h, a), axis=1) / STEP)
        return [(set(ids(2, nl)), m + h.min() * a, a, h.max() - h.min(), np.median(q) * STEP)]

    def measured(i0, i1, b, t, first, open_, factor):
        p, a = xyz(i0, i1), axis(b, t)
        h = np.round((p - b) @ a, 9)
        q = np.round(np.linalg.norm(p - b - np.outer(h, a), axis=1) / STEP)
        inside = (first | (h >= 0)) & (open_ | (h <= np.round(np.linalg.norm(t - b), 9)))
        if not first and inside.sum() < 3:
            inside = h >= 0
        r0 = np.median(q[inside]) if inside.any() else 0
        if r0 == 0 and inside.any():
            r0 = q[inside].mean()
        inside &= (q < factor * r0) | (q == 0)
        found = [pid for pid, i in zip(ids(i0, i1), inside, strict=True) if i]
        return found, (np.median(q[inside]) if inside.any() else 0) * STEP, h[inside].max() if inside.any() else 0, h.min()

    b, t, i = mean(1, 2), mean(3, 4), 4
    found, r, top, low = measured(1, 4, b, t, True, False, 1.5 if stem else 3.0)
    while i <= nl - 1 and (top - low < length * r or len(found) < 30):
        t = mean(i, i)
        i += 1
        found, r, top, low = measured(1, i, b, t, True, False, 3.0)
    most = max(i - 1, 3)
    out = [[set(found), b + low * axis(b, t), axis(b, t), top - low, r]]
    taken = set(found)
    i0, half = most - 1, math.ceil(most / 2)
    i = most + half
    while i <= nl - 1:
        b, t, k = t, mean(i, i), half + 1
        i += 1
        found, r, top, _ = measured(i0, i, b, t, False, False, 3.0)
        while i <= nl - 1 and (np.linalg.norm(t - b) < length * r and k <= most or len(found) < 20):
            t = mean(i, i)
            i += 1
            k += 1
            found, r, top, _ = measured(i0, i, b, t, False, False, 3.0)
        size = np.linalg.norm(t - b)
        if i >= nl - 1:
            found, r, size, _ = measured(i0, nl, b, t, False, True, 3.0)
        new = set(found) - taken
        if len(new) >= 20:
            out.append([new, b, axis(b, t), size, r])
        else:
            out[-1][0] |= new
        i0 = i - 1
        i = i0 + half
    for one, after in zip(out, out[1:], strict=False):
        way = after[1] - one[1]
        if np.linalg.norm(way) > 0:
            one[2], one[3] = way / np.linalg.norm(way), np.linalg.norm(way)
    return out


def curved(r, n_layers, per_layer, radius, bend, noise=0.002, base=(0.0, 0.0, 0.0)):
    """Layers of points round a bent axis, with some points far off."""
    layers = []
    for k in range(n_layers):
        n = max(1, per_layer + int(r.integers(-2, 3)))
        turn, up = r.uniform(0, 2 * math.pi, n), (k + r.uniform(0, 1, n)) * 0.05
        d = radius * (1 - 0.5 * k / n_layers) + r.normal(0, noise, n)
        d = np.where(r.uniform(size=n) < 0.05, d * 5, d)
        layers.append(np.column_stack([base[0] + d * np.cos(turn) + bend * up**2, base[1] + d * np.sin(turn), base[2] + up]))
    return layers


def tables(spark, segments):
    """Points, members and sets of segments given as (tree, segment, parent, layers); each layer's points by four to a set."""
    points, members, sets, walks, pid = [], [], [], {}, 0
    for tree, segment, parent, layers in segments:
        walk, centres = [], []
        for k, layer in enumerate(layers):
            rows, own = [], []
            for j, x in enumerate(layer):
                if j % 4 == 0:
                    centre = pid
                    sets.append((tree, centre, 7 + k, segment, parent))
                    own.append(x)
                points.append((tree, pid, *map(float, x)))
                members.append((tree, pid, centre))
                rows.append((pid, x))
                pid += 1
            walk.append(rows)
            centres.append(own)
        walks[tree, segment] = (walk, centres, parent is None)
    return (
        spark.createDataFrame(points, "tree_id long, pid long, x double, y double, z double"),
        spark.createDataFrame(members, "tree_id long, pid long, centre long"),
        spark.createDataFrame(sets, "tree_id long, centre long, layer long, segment long, parent_segment long"),
        walks,
    )


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(5)
    segments = [
        (1, 1, None, curved(r, 40, 14, 0.15, 0.0)), (1, 2, 1, curved(r, 17, 6, 0.03, 0.3)), (1, 3, 1, curved(r, 3, 12, 0.02, 0.1)), (1, 4, 1, curved(r, 9, 2, 0.02, 0.2)), (1, 5, 2, curved(r, 1, 40, 0.02, 0.0)),
        (1, 6, 2, curved(r, 5, 3, 0.01, 0.0)), (2, 1, None, curved(r, 60, 5, 0.05, 0.4)), (2, 2, 1, curved(r, 4, 30, 0.2, 0.0)), (2, 3, 1, curved(r, 2, 15, 0.02, 0.0)),
        (2, 4, 1, [np.array([[0.0, 0.0, 0.05 * k + 0.01 * j] for j in range(5)]) for k in range(12)]), (2, 5, 1, [np.zeros((8, 3))] * 6),
    ]
    p, m, s, walks = tables(spark, segments)
    found, shapes = regions.regions(p, m, s)
    return p, found.cache(), shapes.cache(), walks


def test_regions_are_those_of_a_walk(made):
    _, found, shapes, walks = made
    got, shape = {}, {(x.tree_id, x.segment, x.region): x for x in shapes.collect()}
    for x in found.collect():
        got.setdefault((x.tree_id, x.segment, x.region), []).append(x.pid)
    want = {(*key, k + 1): one for key, (layers, centres, stem) in walks.items() for k, one in enumerate(walk_regions(layers, centres, stem))}
    assert set(got) == set(want) == set(shape) and len(want) > 15
    for key, (pids, start, axis, length, radius) in want.items():
        x = shape[key]
        assert len(got[key]) == len(set(got[key])) == x.n_points and set(got[key]) == pids, key
        assert [x.sx, x.sy, x.sz] == pytest.approx(list(start), abs=1e-9), (key, x, start, axis)
        assert [x.ax, x.ay, x.az] == pytest.approx(list(axis), abs=1e-9), (key, x, axis)
        assert x.length == pytest.approx(length, abs=1e-9) and x.radius == pytest.approx(radius, abs=1e-9)


def test_regions_are_as_long_as_asked(made):
    _, _, shapes, _ = made
    stem = sorted((x.region, x) for x in shapes.where("tree_id = 1 AND segment = 1").collect())
    assert len(stem) >= 3 and all(x.n_points >= 20 for _, x in stem)
    for _, x in stem[:1]:
        assert x.length >= 3 * x.radius


def test_cylinders_of_regions(made):
    p, found, shapes, _ = made
    c = regions.region_cylinders(p, found, shapes).where("tree_id = 1 AND segment = 1").orderBy("region").toPandas()
    assert len(c) >= 3 and 0.05 < c.radius.median() < 0.2


def test_no_points(spark):
    p, m, s, _ = tables(spark, [])
    found, shapes = regions.regions(p, m, s)
    assert found.count() == 0 and shapes.count() == 0


def test_bases_at_neither_end_are_mended(spark):
    """The first layer lies between the second and third: the first four become one; a segment with its base at an end stays."""
    at = lambda segment, zs: [(1, segment, 10 * segment + k, k, 0.0, 0.01 * (k % 2), z) for k, z in enumerate(zs)]
    rows = at(1, [0.5, 0.0, 1.0, 1.5, 2.0, 2.5]) + at(2, [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]) + at(3, [0.5, 0.0, 1.0])
    s = spark.createDataFrame(rows, "tree_id long, segment long, centre long, layer long, x double, y double, z double")
    got = {r.centre: r.layer for r in regions.mended_bases(s).collect()}
    assert [got[10 + k] for k in range(6)] == [1, 1, 1, 1, 2, 3]
    assert [got[20 + k] for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert [got[30 + k] for k in range(3)] == [1, 2, 3]
