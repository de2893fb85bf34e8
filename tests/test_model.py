"""Parents, starts and radii of branches against a walk over the branches one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.operators import attachment, taper
from canopia.sources import tables

FOLDER = "/root/testdata/sf0.001"
SHAPE = "radius length sx sy sz ax ay az".split()


def walk_control(r, length, above, trunk):
    """Radii of one branch by loops."""
    r = np.array(r, float)
    t = len(r)
    most = max(0.95 * above, 0.001) if above is not None else 3 * r.mean() if trunk else 0.005
    r = np.maximum(np.minimum(r, most), 0.0025)
    if r.max() < 0.005 or t <= 4:
        if t == 1:
            return r
        if t == 2:
            return np.array([r.max(), r.max() / 2])
        if r.max() < 0.005:
            inner = np.sort(r)[1:-1]
            a = 2 * inner.mean()
            a = min(0.01, inner.max()) if a > inner.max() else a
            return np.linspace(a, min(r.min() / 2, 0.001), t)
        return np.linspace(min(r[0] + r[1], r.max()), 0.0025, t)
    ends = np.cumsum(length)
    mid, total = ends - np.array(length) / 2, ends[-1]
    up = lambda x: int(math.floor(x + 0.5))
    parts, inner, slack = (8, 5, 1.1) if trunk else (4, 3, 1.05)
    head = next((i + 1 for i in range(t) if mid[i] >= 2), t) if trunk else math.ceil(t / 10)
    points = [(0.0, slack * r[: max(head, 2)].mean())]
    b, begin = up(t / parts), 0
    for k in range(1, inner + 1):
        if b >= 3:
            at = int(np.argmin(np.abs(mid - k * total / parts)))
            value = 1.05 * r[begin : at + 1].mean()
            if trunk:
                value = min(value, points[-1][1])
            points.append((mid[at], value))
            begin = at + 1
        else:
            at = up(begin + 1 + b / 2)  # past the end of a trunk of five: no cylinder comes that far
            points.append((mid[at - 1] if at <= t else math.nan, 1.05 * r[begin : begin + b].mean()))
            begin += b
    points.append((total, 0.0025))
    x, y = np.array(points).T
    if trunk:
        j = 0
        for i in range(t):
            line = y[j] + (mid[i] - x[j]) * (y[j + 1] - y[j]) / (x[j + 1] - x[j])
            r[i] = min(max(r[i], 0.7 * line), line)
            if j < 5 and mid[i] > x[j + 1]:
                j += 1
        return r
    c = np.linalg.lstsq(np.column_stack([x**2, np.ones(5)]), y, rcond=None)[0]
    curve = c[0] * mid**2 + c[1]
    return np.maximum(np.minimum(r, curve), np.maximum(0.75 * curve, 0.0025))


def walk_parent(first, parents):
    """Which of the parent branch's cylinders, how, and the move."""
    s, a = np.array(first[2:5]), np.array(first[5:8])
    near = sorted(parents, key=lambda p: (round(float(np.linalg.norm(s - p[1][2:5])), 9), p[0]))[:4]
    if len(near) == 1:
        return near[0], "only", 0.0, 0.0
    met = []
    for p in near:
        q, u = np.array(p[1][2:5]), np.array(p[1][5:8])
        side, base = a - (a @ u) * u, (s - q) - ((s - q) @ u) * u
        e, f, g = side @ side, side @ base, base @ base - p[1][0] ** 2
        if e <= 1e-9 or f * f - e * g < 0:
            continue
        far, close = (-f + math.sqrt(f * f - e * g)) / e, (-f - math.sqrt(f * f - e * g)) / e
        h = (s + far * a - q) @ u
        if close > 0 and far >= first[1]:
            met.append((p, 0.0, 0.0, False))
        elif far >= first[1]:
            met.append((p, far, h, True))
        elif 0 <= h <= p[1][1]:
            return p, "moved", far, 0.0
        else:
            met.append((p, far, -h if h < 0 else h - p[1][1], False))
    if not met:
        return near[0], "gap", 0.0, 0.0
    p, move, over, short = min(met, key=lambda m: round(m[2], 9))
    return p, "short" if short else "moved", move, over


def walk_attach(rows, parents, carries):
    """Rows ``(cyl, shape)`` of one branch after attachment, and its parent's number."""
    rows = [(c, list(v)) for c, v in rows]
    if not parents:
        return rows, None
    (parent, shape), how, move, over = walk_parent(rows[0][1], parents)
    v = rows[0][1]
    s, a = np.array(v[2:5]), np.array(v[5:8])
    near = move <= v[0] and abs(over) <= 1.5 * shape[1]
    if how == "moved":
        v[2:5], v[1] = s + move * a, v[1] - move
    elif how == "short" and len(rows) > 1:
        if near:
            w = rows[1][1]
            way = np.array(w[2:5]) + w[1] * np.array(w[5:8]) - (s + move * a)
            w[2:5], w[1], w[5:8] = s + move * a, np.linalg.norm(way), way / np.linalg.norm(way)
        rows = rows[1:]
    elif how == "short" and not carries:
        return [], None
    elif how == "short" and near:
        v[2:5], v[1] = s + move * a, abs(move)
    elif how == "gap":
        q, u = np.array(shape[2:5]), np.array(shape[5:8])
        d = np.linalg.norm(s - q)
        unit = (s - q) / d
        off = np.linalg.norm(unit - (unit @ u) * u) * d
        if off > 0 and d - shape[0] / off * d > 0.005:
            rows = [(None, [v[0], d - shape[0] / off * d, *(q + unit * shape[0] / off * d), *unit])] + rows
    return rows, parent


def walk_join(rows, radii, fitted):
    for i, (c, v) in enumerate(rows):
        changed, was = abs(radii[i] - v[0]), v[0]
        v[0] = radii[i]
        if c in fitted and (changed > 0.01 or changed > was / 2):
            s0, a0 = np.array(fitted[c][2:5]), np.array(fitted[c][5:8])
            gap = np.array(v[2:5]) - s0
            off = np.linalg.norm(gap - (gap @ a0) * a0)
            if off > 0.01 or off > was / 2:
                v[1:8] = fitted[c][1:8]
    for i in range(1, len(rows)):
        b, v = rows[i - 1][1], rows[i][1]
        gap = np.array(v[2:5]) - np.array(b[2:5]) - b[1] * np.array(b[5:8])
        if np.linalg.norm(gap) > 0.0001:
            x = gap @ np.array(v[5:8])
            v[2:5] = np.array(v[2:5]) - x * np.array(v[5:8])
            if x > 0 or v[1] + x > 0:
                v[1] += x


@pytest.mark.parametrize("trunk", [False, True])
def test_radius_control_is_the_walk(spark, trunk):
    r = np.random.default_rng(7)
    branches, rows = {}, []
    for k, t in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 13, 19, 20, 31, 60, 400, 1, 2, 3, 7, 40]):
        radius = np.abs(np.linspace(0.2, 0.004, t) * r.uniform(0.3, 1.6, t)) if k < 14 else r.uniform(0.0005, 0.003, t)
        length, above = r.uniform(0.05, 0.3, t), [None, 0.11, 0.004][k % 3]
        branches[k] = (walk_control(radius, length, above, trunk), above)
        rows += [(1, k, i + 1, i + 1, 0 if trunk else 1, float(radius[i]), float(length[i]), 0.0, 0.0, float(length[:i].sum()), 0.0, 0.0, 1.0) for i in range(t)]
    c = spark.createDataFrame(rows, "tree_id long, branch long, position long, cyl long, branch_order int, " + ", ".join(f"{x} double" for x in SHAPE))
    limits = spark.createDataFrame([(1, k, a) for k, (_, a) in branches.items()], "tree_id long, branch long, parent_radius double")
    got = taper.control_radii(c, limits).collect()
    for k, (want, above) in branches.items():
        own = [x.radius for x in sorted((x for x in got if x.branch == k), key=lambda x: x.position)]
        assert own == pytest.approx(want.tolist(), rel=1e-6), k
        if above and len(own) > 4 and not trunk:
            assert max(own) <= max(0.95 * above, 0.0025) + 1e-12
    assert taper.control_radii(c.limit(0), limits).collect() == []


def test_gap_has_the_length_worked_out_by_hand(spark):
    """A branch 1 m beside a vertical trunk of 0.2 m pointing away along the trunk: its axis meets nothing, and 0.8 of the metre is outside."""
    shape = "tree_id long, branch long, position long, cyl long, branch_order int, " + ", ".join(f"{x} double" for x in SHAPE)
    trunk = [(1, 1, k + 1, k + 1, 0, 0.2, 1.0, 0.0, 0.0, float(k), 0.0, 0.0, 1.0) for k in range(3)]
    branch = [(1, 2, 1, 4, 1, 0.05, 0.5, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0)]
    touching = [(1, 3, 1, 5, 1, 0.05, 0.5, 0.204, 0.0, 1.0, 0.0, 1.0, 0.0)]
    c = spark.createDataFrame(trunk + branch + touching, shape)
    b = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1)], "tree_id long, branch long, parent_branch long")
    got = {(x.branch, x.position): x for x in attachment.attach(c, c, b).collect()}
    assert len(got) == 6 and (3, 2) not in got  # a gap of 4 mm is let be
    added, old = got[2, 1], got[2, 2]
    assert added.added and added.length == pytest.approx(0.8) and (added.sx, added.sz) == pytest.approx((0.2, 1.0)) and added.parent == 2 and added.radius == 0.05
    assert not old.added and old.parent == added.cyl and old.length == 0.5


def test_rebuilt_model_is_the_walk(spark):
    c = tables.cylinders(spark, FOLDER).cache()
    b = tables.branches(spark, FOLDER).select("tree_id", "branch", F.col("parent").alias("parent_branch"))
    up = {x.branch: x.parent_branch for x in b.collect()}
    rows, fitted = {}, {}
    for x in c.orderBy("branch", "position").collect():
        rows.setdefault((x.branch_order, x.tree_id, x.branch), []).append((x.cyl, [x[k] for k in SHAPE]))
        fitted[x.tree_id, x.cyl] = [x[k] for k in SHAPE]
    done, want = {}, {}
    for (order, tree, branch), own in sorted(rows.items()):
        parents = [(n, v) for n, (_, v) in enumerate(done.get(up[branch], []))]
        # Numbers of an order are not those of the whole model yet: ties are broken by the old numbers, bridges first.
        names = [-up[branch] if k is None else k for k, _ in done.get(up[branch], [])]
        kept, parent = walk_attach(own, [(names[n], v) for n, v in parents], branch in up.values())
        above = None if parent is None else dict(zip(names, [v for _, v in parents], strict=True))[parent][0]
        if kept:
            radii = walk_control([v[0] for _, v in kept], [v[1] for _, v in kept], above, order == 0)
            walk_join(kept, radii, {k: fitted[tree, k] for k, _ in kept if k is not None})
        done[branch] = kept
        want[branch] = [v for _, v in kept]
    got = {}
    for x in attachment.rebuild(c, b).orderBy("branch", "position").collect():
        got.setdefault(x.branch, []).append([x[k] for k in SHAPE])
        assert not x.added or x.length > 0.0049
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items() if v}
    wrong = sum(not np.allclose(got[k], want[k], atol=1e-6) for k in got)
    assert wrong == 0
