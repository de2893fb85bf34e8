"""Operators on hand-computed tables and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canopia.operators import graph, inventory, lightmeter, spatial, tree
from canopia.operators.components import connected_components


def test_stem_circle(spark):
    ring = [(7, k, 2 + 0.15 * math.cos(k * math.pi / 4), 3 + 0.15 * math.sin(k * math.pi / 4), 1.30) for k in range(8)]
    rows = [*ring, (7, 8, 2.0, 3.0, 0.0), (7, 9, 2.0, 3.0, 10.0), (7, 10, 9.0, 9.0, 1.27), (7, 11, 9.0, 9.0, 1.33), (8, 0, 0.0, 0.0, 0.0), (8, 1, 0.0, 0.0, 9.0)]
    p = spark.createDataFrame(rows, "tree_id long, pid long, x double, y double, z double")
    assert inventory.breast_slice(p).where("tree_id = 7").count() == 8
    got = {r.tree_id: tuple(r)[1:] for r in inventory.inventory(p).collect()}
    assert got == {7: (2.0, 3.0, 30.0, 10.0), 8: (None, None, None, 9.0)}


def cylinders(spark):
    rows = [
        (1, 1, 0, 1, 1, None, 0.10, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 0, 2, 2, 1, 0.08, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0),
        (1, 2, 1, 1, 3, 2, 0.02, 0.5, 0.08, 0.0, 1.5, 1.0, 0.0, 0.0), (1, 2, 1, 2, 4, 3, 0.01, 0.5, 0.58, 0.0, 1.5, 1.0, 0.0, 0.0),
    ]
    return spark.createDataFrame(rows, "tree_id long, branch long, branch_order int, position long, cyl long, parent long, radius double, length double, sx double, sy double, sz double, ax double, ay double, az double")


def test_tree_attributes(spark):
    c = cylinders(spark)
    t = tree.totals(c).first()
    assert [round(x, 3) for x in (t.trunk_volume, t.branch_volume, t.total_volume, t.trunk_length, t.branch_length)] == [51.522, 0.785, 52.308, 2.0, 1.0]
    assert t.area == pytest.approx(2 * math.pi * 0.195)
    assert tree.height(c).first().height == 1.5 and tree.height(c, to_tip=True).first().height == 2.0
    assert tree.breast_diameter(c).first().dbh_cm == 16
    b = {r.branch: r for r in tree.branch_table(c).collect()}
    assert b[2].angle == pytest.approx(90) and b[1].angle is None and b[2].parent_branch == 1
    bins = {r.bin: round(r.volume, 3) for r in tree.height_bins(c).collect()}
    assert bins == {0: 31.416, 1: 20.892, 2: 0} or bins == {0: 31.416, 1: 20.892}


def test_nearest_reading(spark):
    s = lambda h: h * 1_000_000
    rows = [("A", 1, 1, s(0), 1.0), ("A", 1, 2, s(30), 2.0), ("B", 1, 3, s(14), 0.0), ("B", 1, 4, s(15), 0.0), ("B", 1, 5, s(16), 0.0), ("B", 1, 6, s(31), 0.0), ("B", 1, 7, s(30), 0.0), ("B", 2, 8, s(1), 0.0)]
    r = spark.createDataFrame(rows, "kind string, day int, seq long, micros long, value double")
    assert {x.seq: x.a_value for x in lightmeter.nearest_reading(r).collect()} == {3: 1, 4: 2, 5: 2, 6: 2, 7: 2}


def test_area_index(spark):
    g = spark.createDataFrame([(1, *[math.exp(-1)] * 5)] * 3, "p int, g1 double, g2 double, g3 double, g4 double, g5 double")
    rings = [f"g{k}" for k in range(1, 6)]
    assert lightmeter.effective_area_index(g, ["p"], rings).first().paie == pytest.approx(1.2549, abs=1e-4)
    assert lightmeter.area_index(g, ["p"], rings).first().pai == pytest.approx(1.2549, abs=1e-4)
    assert lightmeter.area_index(g, ["p"], ["g4"], (1.662,), (1.0,)).first().pai == pytest.approx(1.2034, abs=1e-4)


def walk(points, dmin, rcov, nmin):
    d = lambda a, b: math.dist(a[1:], b[1:])
    centres, done = [], set()
    for p in points:
        if p[0] in done or sum(d(p, q) < rcov for q in points) < nmin:
            continue
        centres.append(p)
        done.update(q[0] for q in points if d(p, q) < dmin)
    members = {}
    for q in points:
        near = [(d(c, q), k) for k, c in enumerate(centres) if d(c, q) < rcov]
        if near:
            members[q[0]] = centres[min(near)[1]][0]
    return {c[0] for c in centres}, members


@pytest.mark.parametrize("nmin,want", [(1, {0, 2, 4}), (3, {1, 3})])
def test_cover_of_a_line(spark, nmin, want):
    p = [(k, float(k), 0.0, 0.0) for k in range(5)]
    centres, members = spatial.cover(spark.createDataFrame([(1, *x) for x in p], "tree_id long, pid long, x double, y double, z double"), 1.5, 1.6, nmin)
    assert {r.pid for r in centres.collect()} == want == walk(p, 1.5, 1.6, nmin)[0]
    assert {r.pid: r.centre for r in members.collect()} == walk(p, 1.5, 1.6, nmin)[1]


def test_cover_is_the_walk(spark):
    r = random.Random(4)
    p = [(k, r.random(), r.random(), r.random() / 3) for k in range(150)]
    df = spark.createDataFrame([(1, *x) for x in p], "tree_id long, pid long, x double, y double, z double")
    centres, members = spatial.cover(df, 0.15, 0.2, 2)
    want = walk(p, 0.15, 0.2, 2)
    assert {x.pid for x in centres.collect()} == want[0] and {x.pid: x.centre for x in members.collect()} == want[1]
    seeded, _ = spatial.cover(df, 0.15, 0.2, 2, seed=3)
    rows = {x.pid: p[x.pid] for x in seeded.collect()}
    assert all(math.dist(a[1:], b[1:]) >= 0.15 for a in rows.values() for b in rows.values() if a is not b)
    near = spatial.cover_neighbours(df, members, 0.2).collect()
    assert {(x.a, x.b) for x in near} == {(x.b, x.a) for x in near}
    wide = spatial.varying_radius_pairs(df, df, F.lit(0.2), 0.2, 0.1)
    assert wide.count() == spatial.radius_pairs(df, df, 0.2).count()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 5), (None, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "node long")
    assert {(r.node, r.component) for r in graph.components(edges, nodes, 2).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = spark.range(1, 2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [r.component for r in connected_components(chain).select("component").distinct().collect()] == [1]
    assert connected_components(edges.limit(0)).collect() == []


def test_depths_and_subtrees(spark):
    n = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 2, 4.0), (1, 4, 2, 8.0), (2, 1, None, 1.0), (1, 9, 77, 1.0), (3, 5, 6, 1.0), (3, 6, 5, 1.0)], "tree_id long, branch long, parent long, v double")
    got = {(r.tree_id, r.branch): r.depth for r in graph.depths(n.where("tree_id < 3"), ["tree_id", "branch"]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 2, (2, 1): 0, (1, 9): None}
    sums = {(r.tree_id, r.branch): (r.n_below, r.v_sum) for r in graph.subtree_sums(n.where("tree_id = 1 AND branch < 9"), ["tree_id", "branch"], "v").collect()}
    assert sums == {(1, 1): (3, 15), (1, 2): (2, 14), (1, 3): (0, 4), (1, 4): (0, 8)}


def test_hull_of_outer_cells_is_the_whole_hull(spark):
    import numpy as np

    from canopia.operators import crown

    r = np.random.default_rng(2)
    p = r.normal(size=(400, 2))
    df = spark.createDataFrame([(1, k, float(x), float(y), 0.0) for k, (x, y) in enumerate(p)], "tree_id long, pid long, x double, y double, z double")
    got = crown.hulls(df, 7).first()
    assert (got.area, got.xc, got.yc) == pytest.approx(crown.hull(p))
    assert crown.hull(np.array([[0.0, 0], [2, 0], [2, 2], [0, 2], [1, 1]])) == pytest.approx((4, 1, 1)) and crown.hull(np.zeros((3, 2)))[0] == 0


def test_height_clusters_are_the_walk(spark):
    from canopia.operators import features

    r = random.Random(3)
    heights = {t: [round(r.uniform(0, 4), 3) for _ in range(n)] for t, n in ((1, 12), (2, 1), (3, 30))}
    rows = [(t, 1, h) for t, hs in heights.items() for h in hs]
    want = {}
    for t, hs in heights.items():
        n, first = 0, -math.inf
        for h in sorted(hs):
            if h - first > 0.4:
                n, first = n + 1, h
        want[t] = len(hs) / n
    got = features.height_clusters(spark.createDataFrame(rows, "tree_id long, branch_order int, height double"))
    assert {x.tree_id: x.value for x in got.collect()} == pytest.approx(want)


def test_subtree_sums_of_a_chain_deeper_than_64(spark):
    n = spark.createDataFrame([(1, i, i - 1 if i else None, 1.0) for i in range(70)], "tree_id long, branch long, parent long, v double")
    sums = {r.branch: (r.n_below, r.v_sum) for r in graph.subtree_sums(n, ["tree_id", "branch"], "v").collect()}
    assert sums == {i: (69 - i, 70.0 - i) for i in range(70)}


def test_main_directions_are_eigenvectors(spark, small_dir):
    import numpy as np

    from canopia.operators.spatial import main_directions
    from canopia.sources import tables

    p = tables.points(spark, small_dir)
    clouds = {}
    for r in p.collect():
        clouds.setdefault(r.tree_id, []).append((r.x, r.y, r.z))
    got = main_directions(p).collect()
    assert len(got) == len(clouds)
    for r in got:
        values, vectors = np.linalg.eigh(np.cov(np.array(clouds[r.tree_id]).T))
        for own, k in (((r.along_x, r.along_y, r.along_z), 2), ((r.across_x, r.across_y, r.across_z), 0)):
            assert abs(abs(float(np.dot(own, vectors[:, k]))) - 1) < 1e-6


def test_greedy_and_component_filters(spark):
    import random

    from canopia.operators.spatial import component_filter, cover, cover_neighbours, greedy_density_filter, nearest_between

    r = random.Random(4)
    rows = [(t, t * 1000 + k, r.random(), r.random(), r.random() * 0.5) for t in (1, 2) for k in range(150)]
    p = spark.createDataFrame(rows, "tree_id long, pid long, x double, y double, z double").cache()
    near = lambda a, b, d: sum((x - y) ** 2 for x, y in zip(a[2:], b[2:], strict=True)) ** 0.5 < d
    most = {}
    for t in (1, 2):
        cloud, seen = [x for x in rows if x[0] == t], set()
        for a in cloud:  # the walk
            if a[1] not in seen:
                ball = [b[1] for b in cloud if near(a, b, 0.2)]
                seen.update(ball)
                for b in ball:
                    most[b] = max(most.get(b, 0), len(ball))
    got = {x.pid: x.n for x in greedy_density_filter(p, 0.2, 4).collect()}
    assert got == {k: n for k, n in most.items() if n >= 4} and 0 < len(got) < len(rows)
    centres, members = cover(p, 0.1, 0.15, 1)
    of = {x.pid: x.centre for x in members.collect()}
    root = {x.pid: x.pid for x in centres.collect()}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in cover_neighbours(p, members, 0.15).collect():
        root[find(x.a)] = find(x.b)
    size = {}
    for k in root:
        size[find(k)] = size.get(find(k), 0) + 1
    kept = {x.pid for x in component_filter(p, 0.1, 5).collect()}
    assert kept == {k for k, c in of.items() if size[find(c)] >= 5}
    even, odd = p.where("pid % 2 = 0"), p.where("pid % 2 = 1")
    for x in nearest_between(even, odd, 0.001).collect():
        cloud = [y for y in rows if y[0] == x.tree_id]
        want = min(sum((u - v) ** 2 for u, v in zip(a[2:], b[2:], strict=True)) ** 0.5 for a in cloud if a[1] % 2 == 0 for b in cloud if b[1] % 2)
        assert abs(x.dist - want) < 1e-12


def test_surfaces_stand_at_the_radius(spark):
    from pyspark.sql import functions as F

    from canopia.functions.vectors import axis_distance, vector
    from canopia.operators.crown import surface_points
    from canopia.operators.mesh import cylinder_grid

    s = 0.5**0.5
    c = spark.createDataFrame([(1, 1, 0, 0.2, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 2, 1, 0.05, 1.0, 0.0, 0.0, 2.0, s, 0.0, s)], "tree_id long, cyl long, branch_order int, radius double, length double, sx double, sy double, sz double, ax double, ay double, az double")
    grid = cylinder_grid(c, 9).join(c, ["tree_id", "cyl"])
    d, h = axis_distance(vector("x", "y", "z"), vector("sx", "sy", "sz"), vector("ax", "ay", "az"))
    assert grid.count() == 2 * 81 and grid.where((F.abs(d - F.col("radius")) > 1e-9) | (h < -1e-9) | (h > F.col("length") + 1e-9)).count() == 0
    assert surface_points(c).count() == 48 + 4 + 3  # the trunk's tip is the branch's start


def test_features_of_a_tree_by_hand(spark):
    """Two trunk cylinders and a level branch of two: values worked out on paper."""
    import math

    from canopia.operators import distributions as dist
    from canopia.operators import features, tree
    from canopia.operators.crown import crown_base

    rows = [
        (1, 1, 0, 1, 1, None, 0.10, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 0, 2, 2, 1, 0.08, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0),
        (1, 2, 1, 1, 3, 2, 0.02, 0.5, 0.08, 0.0, 1.5, 1.0, 0.0, 0.0), (1, 2, 1, 2, 4, 3, 0.01, 0.5, 0.58, 0.0, 1.5, 1.0, 0.0, 0.0),
    ]
    c = spark.createDataFrame(rows, "tree_id long, branch long, branch_order int, position long, cyl long, parent long, radius double, length double, sx double, sy double, sz double, ax double, ay double, az double")
    near = lambda a, b: abs(a - b) < 1e-9
    dbh = tree.breast_diameter(c)
    assert near(dbh.first()["dbh_cm"], 16.0)
    b = tree.branch_table(c)
    assert near(b.where("branch_order = 1").first()["length"] / 16.0, 0.0625) and near(features.neighbour_gap(b).first()["value"], 0.5)
    volume = {1: 1000 * math.pi * 0.01, 2: 1000 * math.pi * 0.0064, 3: 1000 * math.pi * 0.0004 * 0.5, 4: 1000 * math.pi * 0.0001 * 0.5}
    heights = dist.cylinder_distributions(c).where("dist = 'VolHei'")
    got = {r.bin: r.value for r in heights.collect()}
    assert near(got[0], volume[1]) and near(got[1], volume[2] + volume[3] + volume[4]) and len(got) == 2
    share = volume[1] / sum(volume.values())  # 0.6006
    assert [(r.pct, r.value) for r in dist.quantile_places(heights).orderBy("pct").collect()] == [(k, 0.5 if k <= 12 else 1.0) for k in range(1, 20)]
    even = {r.ref: r for r in dist.reference_differences(heights).collect()}
    assert len(even) == 50 and near(even["uniform_0_5"].mean_diff, share - 0.5) and near(even["uniform_0_5"].max_diff, share - 0.5)
    orders = dist.order_distributions(b).where("dist = 'VolBranchOrd'")
    sums = {(r.low, r.high): r.per_n for r in dist.interval_sums(orders, spark.createDataFrame([(1, 2.0)], "tree_id long, n double"), ["n"], dist.ORDERS, False).collect()}
    assert near(sums[(1, 1)], (volume[3] + volume[4]) / 2) and near(sums[(1, 5)], (volume[3] + volume[4]) / 2) and sums[(2, 5)] == 0 and len(sums) == 15
    assert near(crown_base(c, dbh).first()["crown_base"], 1.5)
    s = dist.branch_statistics(b, ["length", "diameter"])
    whole = {(r.orders, r.column): r for r in s.collect()}
    assert near(whole[(0, "length")].median, 1.0) and near(whole[(1, "diameter")].mean_of_most, 1.0) and len(whole) == 4
    assert near(next(r.value for r in dist.mean_ratios(s).collect() if (r.orders, r.a, r.b) == (0, "diameter", "length")), 0.04)


def test_shapes_of_sets(spark):
    """A line, a plane, a single point and points in one place, each a set of its own."""
    import numpy as np

    from canopia.operators.spatial import main_directions

    r = np.random.default_rng(8)
    sets = {1: np.outer(r.normal(size=40), [1, 2, 2]) + r.normal(0, 0.001, (40, 3)), 2: r.normal(size=(60, 3)) * [1, 1, 0.001], 3: np.ones((1, 3)), 4: np.ones((5, 3))}
    rows = [(1, k, *map(float, x)) for k, p in sets.items() for x in p]
    p = spark.createDataFrame(rows, "tree_id long, centre long, x double, y double, z double")
    got = {x.centre: x for x in main_directions(p, ("tree_id", "centre"), shape=True).collect()}
    assert got[1].linear > 0.99 and abs(got[1].along_x - 1 / 3) < 0.01 and got[2].planar > 0.5 and abs(got[2].across_z) > 0.99
    assert got[3].linear is None and got[3].along_x is None and got[4].linear is None and got[4].n_points == 5
    for k in (1, 2):
        e = np.linalg.eigvalsh(np.cov(sets[k].T))[::-1]
        assert np.allclose([got[k].linear, got[k].planar, got[k].scattered], [(e[0] - e[1]) / e[0], (e[1] - e[2]) / e[0], e[2] / e[0]], atol=1e-9)


def test_nearest_of_far_and_near_sets(spark):
    """Sets that touch, lie far apart, are one place, or stand alone; against all pairs."""
    import numpy as np

    from canopia.operators.spatial import nearest_between

    r = np.random.default_rng(12)
    sets = {1: (r.normal(size=(300, 3)), r.normal(size=(300, 3))), 2: (r.normal(size=(400, 3)), r.normal(size=(400, 3)) + [900, -50, 3]), 3: (np.zeros((5, 3)), np.zeros((4, 3))), 4: (r.normal(size=(5, 3)), np.zeros((0, 3)))}
    sets[5] = (np.array([[x * 0.1, y * 0.1, 0.0] for x in range(20) for y in range(20)]), np.array([[x * 0.1, y * 0.1, 5.0] for x in range(20) for y in range(20)]))
    frame = lambda i: spark.createDataFrame([(t, 10 * k + i, *map(float, x)) for t, s in sets.items() for k, x in enumerate(s[i])] + [(1, 10_000 + i, None, 0.0, 0.0)], "tree_id long, pid long, x double, y double, z double")
    got = {x.tree_id: (round(x.dist, 9), x.pid_a, x.pid_b) for x in nearest_between(frame(0), frame(1), 0.05).collect()}
    want = {t: min((round(float(np.linalg.norm(p - q)), 9), 10 * i, 10 * j + 1) for i, p in enumerate(a) for j, q in enumerate(b)) for t, (a, b) in sets.items() if len(b)}
    assert got == want
    none = frame(0).limit(0)
    assert nearest_between(none, frame(1), 0.05).count() == 0
