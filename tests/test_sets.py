"""Cover sets and trunks against walks and loops, and on a made-up plot."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.operators import spatial, trunk

POINTS = "tree_id long, pid long, x double, y double, z double"


def cloud(seed, n, depth=0.3):
    r = random.Random(seed)
    return [(k, r.random(), r.random(), r.random() * depth) for k in range(n)]


def frame(spark, p, size=None):
    if size is None:
        return spark.createDataFrame([(1, *x) for x in p], POINTS)
    return spark.createDataFrame([(1, *x, size[x[0]]) for x in p], POINTS + ", size long")


def walk(points, size, dmin, rcov, nmin):
    """Centres and members of a cover with sizes, one point after the other."""
    share = {k: v / 256 * 0.5 + 0.5 for k, v in size.items()}
    reach = lambda k: dmin * share[k] + rcov - dmin
    centres, done = [], set()
    for p in points:
        if p[0] in done or sum(math.dist(p[1:], q[1:]) < reach(p[0]) for q in points) < nmin:
            continue
        centres.append(p)
        done.update(q[0] for q in points if math.dist(p[1:], q[1:]) < dmin * share[p[0]])
    members = {}
    for q in points:
        near = [(math.dist(c[1:], q[1:]), k) for k, c in enumerate(centres) if math.dist(c[1:], q[1:]) < reach(c[0])]
        if near:
            members[q[0]] = centres[min(near)[1]][0]
    return {c[0] for c in centres}, members


@pytest.mark.parametrize("seed,nmin", [(1, 1), (2, 3), (3, 2)])
def test_variable_cover_is_the_walk(spark, seed, nmin):
    p = cloud(seed, 170)
    size = {k: random.Random(k * 7 + seed).choice([1, 20, 128, 200, 256]) for k, *_ in p}
    centres, members = spatial.cover(frame(spark, p, size), 0.2, 0.25, nmin, sizes="size")
    want = walk(p, size, 0.2, 0.25, nmin)
    assert {r.pid for r in centres.collect()} == want[0]
    assert {r.pid: r.centre for r in members.collect()} == want[1]


def test_full_sizes_are_the_plain_cover_and_lines_end(spark):
    p = cloud(5, 120)
    plain, sized = spatial.cover(frame(spark, p), 0.2, 0.25, 1)[1], spatial.cover(frame(spark, p, {k: 256 for k, *_ in p}), 0.2, 0.25, 1, sizes="size")[1]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sized.collect()))
    assert spatial.cover(frame(spark, p).limit(0), 0.2, 0.25, 1)[1].collect() == []
    line = [(k, k * 0.1, 0.0, 0.0) for k in range(26)]  # in order of pid a round for each centre
    assert spatial.cover(frame(spark, line), 0.15, 0.16, 1)[0].count() == 13


def loop_neighbours(points, members, dmin, rcov):
    at = {k: np.array(x) for k, *x in points}
    sets = {}
    for p, c in members.items():
        sets.setdefault(c, []).append(p)
    out = set()
    for i in sets:
        near = sorted({members[p] for p in at if p in members and members[p] != i and np.linalg.norm(at[p] - at[i]) < rcov})
        if len(near) == 1:
            out |= {(i, near[0])}
            continue
        if not near:
            continue
        rows = []
        for j in near:
            t = at[j] - at[i]
            length = np.linalg.norm(t)
            t = t / length
            both = max((at[p] - at[i]) @ t for p in sets[i]) + abs(min((at[p] - at[j]) @ t for p in sets[j]))
            rows.append((length, both, length - both, t))
        keep = [r[1] > 0.8 * r[0] or r[2] < dmin / 2 for r in rows] if any(r[1] > 0.8 * r[0] for r in rows) else [r[1] > 0.6 * r[0] or r[2] < rcov / 2 for r in rows]
        if any(keep) and not all(keep) and sum(keep) <= 2:
            first = min(range(len(rows)), key=lambda k: (rows[k][0], near[k]))
            far = [k for k in range(len(rows)) if rows[k][3] @ rows[first][3] < -0.3]
            if far and not any(keep[k] for k in far):
                best = min(far, key=lambda k: (rows[k][0], near[k]))
                keep[best] = rows[best][2] < rcov
        out |= {(i, j) for j, k in zip(near, keep, strict=True) if k}
    return out | {(b, a) for a, b in out}


@pytest.mark.parametrize("seed,depth", [(1, 0.3), (2, 0.05), (3, 0.0)])
def test_true_neighbours_are_the_loop(spark, seed, depth):
    p = cloud(seed, 220, depth)
    df = frame(spark, p)
    members = spatial.cover(df, 0.12, 0.2, 1)[1].cache()
    got = {(r.a, r.b) for r in spatial.true_neighbours(df, members, 0.12, 0.2).collect()}
    assert got == loop_neighbours(p, {r.pid: r.centre for r in members.collect()}, 0.12, 0.2)
    assert got < {(r.a, r.b) for r in spatial.cover_neighbours(df, members, 0.2).collect()}


def plot():
    """Two stems (trees 1 and 2), each with a shrub beside it and a low branch hanging down; sets are points 0.1 apart."""
    rows = []
    for tree in (1, 2):
        k = tree * 10_000
        for h in range(34):
            for a in range(6):
                rows.append((tree, k, 0.15 * math.cos(a * math.pi / 3) + tree, 0.15 * math.sin(a * math.pi / 3), h * 0.18, "stem"))
                k += 1
        for h in range(8):
            for a in range(3):
                rows.append((tree, k, tree + 1.5 + 0.1 * a, 0.0, h * 0.1, "shrub"))
                k += 1
        for d in range(30):
            rows.append((tree, k, tree + 0.25 + 0.02 * d, 0.0, 5.4 - 0.09 * d, "hanging"))
            k += 1
    return rows


def test_trunk_is_found_and_grows_up(spark):
    rows = plot()
    sets = spark.createDataFrame([r[:5] for r in rows], "tree_id long, centre long, x double, y double, z double")
    p = sets.withColumnRenamed("centre", "pid")
    near = spatial.radius_pairs(p, p, 0.24).where("pid_a <> pid_b").select("tree_id", F.col("pid_a").alias("a"), F.col("pid_b").alias("b")).cache()
    what = {(r[0], r[1]): r[5] for r in rows}
    foot = trunk.trunk_slice(sets, trunk.trunk_cells(sets), near).collect()
    assert {what[r.tree_id, r.centre] for r in foot} == {"stem"} and {r.tree_id for r in foot} == {1, 2}
    base = sets.where("z < 0.05").join(spark.createDataFrame([(t, c) for t, c in what if what[t, c] == "stem"], "tree_id long, centre long"), ["tree_id", "centre"]).select("tree_id", "centre")
    grown = {(r.tree_id, r.centre): r.round for r in trunk.grow_trunk(sets, near, base).collect()}
    names = [what[k] for k in grown]
    assert names.count("stem") == 2 * 204 and names.count("hanging") <= 2 * 16 and "shrub" not in names
    # The walk: neighbours of what was taken last, not lower than a twentieth of the height below its highest.
    z, links = {(r[0], r[1]): r[4] for r in rows}, {}
    for r in near.collect():
        links.setdefault((r.tree_id, r.a), []).append((r.tree_id, r.b))
    for tree in (1, 2):
        start = {(r.tree_id, r.centre) for r in base.collect() if r.tree_id == tree}
        taken, front, step = set(start), set(start), 0.05 * (max(v for k, v in z.items() if k[0] == tree))
        first = True
        top = -math.inf
        while front:
            new = {b for a in front for b in links.get(a, [])} - taken
            new = {k for k in new if first or z[k] >= top - step}
            taken |= new
            top = max((z[k] for k in (taken if first else new)), default=0)
            first, front = False, new
        assert {k for k in grown if k[0] == tree} == taken
    assert trunk.grow_trunk(sets, near, base.limit(0)).collect() == []


def test_components_attach_to_the_nearest(spark):
    """A tree at 0, ground at 10; pieces between go to what is nearest, and one far away stays other."""
    xs = {0: "tree", 1: None, 2: None, 3: "forb"}
    at = {0: 0.0, 1: 0.35, 2: 9.6, 3: 10.0, 4: 0.7, 5: 0.75, 6: 50.0, 7: 9.3}
    sets = spark.createDataFrame([(1, k, x, 0.0, 0.0) for k, x in at.items()], "tree_id long, centre long, x double, y double, z double")
    near = spark.createDataFrame([(1, 4, 5), (1, 5, 4)], "tree_id long, a long, b long")
    labels = spark.createDataFrame([(1, k, v) for k, v in xs.items() if v], "tree_id long, centre long, label string")
    got = {r.centre: r.label for r in trunk.attach_components(sets, near, labels, 0.1, 2.0).collect()}
    assert got == {0: "tree", 1: "tree", 4: "tree", 5: "tree", 2: "forb", 3: "forb", 7: "forb", 6: "other"}
    assert trunk.attach_components(sets.limit(0), near.limit(0), labels.limit(0), 0.1, 2.0).collect() == []


@pytest.mark.parametrize("seed", [2])
def test_attachment_is_the_loop(spark, seed):
    p = cloud(seed, 60, 0.2)
    at = {k: np.array(x) for k, *x in p}
    dmin, r0 = 0.02, 0.06
    links = {(a, b) for a in at for b in at if a != b and np.linalg.norm(at[a] - at[b]) < r0}
    label = {0: "tree", 1: "forb"}
    sets = spark.createDataFrame([(1, *x) for x in p], "tree_id long, centre long, x double, y double, z double")
    near = spark.createDataFrame([(1, a, b) for a, b in links], "tree_id long, a long, b long")
    got = {r.centre: (r.label, r.joined_at) for r in trunk.attach_components(sets, near, spark.createDataFrame([(1, k, v) for k, v in label.items()], "tree_id long, centre long, label string"), dmin, 1.0).collect()}
    known, k = {c: (v, 0.0) for c, v in label.items()}, 10
    while k * dmin <= 1.0 and len(known) < len(at):
        part = {}
        for c in sorted(set(at) - set(known)):
            if c not in part:
                todo = [c]
                while todo:
                    x = todo.pop()
                    if x not in part:
                        part[x] = c
                        todo += [b for a, b in links if a == x and b not in known]
        new, tied = {}, []
        for c in sorted(set(part.values())):
            own = [x for x in part if part[x] == c]
            best = {}
            for a in own:
                for b in at:
                    if part.get(b) != c and np.linalg.norm(at[a] - at[b]) < k * dmin:
                        kind = known[b][0] if b in known else "other"
                        best[kind] = min(best.get(kind, (math.inf,)), (np.linalg.norm(at[a] - at[b]), a, b))
            if not best:
                continue
            t, f, o = (best.get(x, (math.inf,)) for x in ("tree", "forb", "other"))
            if f[0] <= o[0] and f[0] <= t[0]:
                new |= {x: ("forb", k * dmin) for x in own}
            elif t[0] <= o[0] or t[0] <= 2 * dmin:
                new |= {x: ("tree", k * dmin) for x in own}
            else:
                tied.append(o[1:])
        known |= new
        links |= set(tied) | {(b, a) for a, b in tied}
        if not new and not tied:
            k += 10
    want = {c: known.get(c, ("other", None)) for c in at}
    assert {c: v[0] for c, v in got.items()} == {c: v[0] for c, v in want.items()}
