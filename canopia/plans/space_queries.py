"""Queries over neighbourhoods, branch trees and surfaces, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import graph, mesh, segmentation, spatial, tree
from canopia.plans.oracle import with_tables
from canopia.plans.tree_queries import V, rounded
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}
RADIUS = 0.04


def query(sql: str | None = None, *names: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_tables(sql, *names, recursive=recursive)
        return f

    return add


CELL = ", ".join(f"CAST(floor(({c} - min({c}) OVER (PARTITION BY tree_id)) / 0.05) AS BIGINT) AS c{c}" for c in "xyz")


@query(f", v AS (SELECT tree_id, {CELL} FROM points) SELECT tree_id, cx, cy, cz, count(*) AS n FROM v GROUP BY ALL", "points")
def geo1_voxels(spark, sf_dir):
    return spatial.voxels(tables.points(spark, sf_dir), 0.05).groupBy("tree_id", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


def _near(radius: float) -> str:
    """Pairs by cells of the radius, as any engine would join them."""
    return f""", g AS (SELECT *, CAST(floor(x / {radius}) AS BIGINT) AS cx, CAST(floor(y / {radius}) AS BIGINT) AS cy, CAST(floor(z / {radius}) AS BIGINT) AS cz FROM points),
o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b, (SELECT unnest([-1, 0, 1]) AS d) c),
e AS (SELECT g.*, cx + dx AS ex, cy + dy AS ey, cz + dz AS ez FROM g, o),
near AS (SELECT e.tree_id, e.pid AS pid_a, g.pid AS pid_b, sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y) + (e.z - g.z) * (e.z - g.z)) AS dist
  FROM e JOIN g ON g.tree_id = e.tree_id AND g.cx = e.ex AND g.cy = e.ey AND g.cz = e.ez WHERE sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y) + (e.z - g.z) * (e.z - g.z)) < {radius})"""


@query(_near(RADIUS) + " SELECT tree_id, pid_a, pid_b, round(dist, 6) + 0.0 AS dist FROM near WHERE pid_a < pid_b", "points")
def joi2_radius_pairs(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    return rounded(spatial.radius_pairs(p, p, RADIUS).where("pid_a < pid_b"), 6)


@query(_near(RADIUS) + " SELECT tree_id, pid_a AS pid, count(*) AS n FROM near GROUP BY ALL", "points")
def fil4_neighbour_counts(spark, sf_dir):
    return spatial.neighbour_counts(tables.points(spark, sf_dir), RADIUS)


@query(_near(RADIUS) + """, k AS (SELECT tree_id, pid_a AS pid, count(*) AS n FROM near GROUP BY ALL),
l AS (SELECT p.tree_id, p.pid, p.z, k.n, CAST(floor(p.z * 10 - min(p.z * 10) OVER (PARTITION BY p.tree_id)) AS BIGINT) + 1 AS layer FROM points p JOIN k ON p.tree_id = k.tree_id AND p.pid = k.pid),
m AS (SELECT tree_id, layer, ceil(avg(n)) AS mean FROM l GROUP BY ALL), s AS (SELECT tree_id, mean AS second FROM m WHERE layer = 2)
SELECT l.tree_id, l.pid, l.layer, l.n FROM l JOIN m ON m.tree_id = l.tree_id AND m.layer = l.layer LEFT JOIN s ON s.tree_id = l.tree_id
WHERE l.n >= CASE WHEN l.layer <= 2 OR second IS NULL THEN 6 ELSE greatest(ceil(mean * 6 / second), ceil(6 / 3.0)) END""", "points")
def fil5_density_filter(spark, sf_dir):
    """Coordinates times ten, so that the clouds have several metre layers."""
    p = tables.points(spark, sf_dir).select("tree_id", "pid", *[(F.col(c) * 10).alias(c) for c in "xyz"])
    return spatial.density_filter(p, RADIUS * 10, 6).select("tree_id", "pid", "layer", "n")


@query("SELECT tree_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, min(pid) AS pid FROM points GROUP BY tree_id, points.x, points.y, points.z", "points")
def fil2_without_repeats(spark, sf_dir):
    return rounded(spatial.without_repeats(tables.points(spark, sf_dir)), 6)


@query()
def geo3_cover_sets(spark, sf_dir):
    """Tested against the walk over the points one by one."""
    return rounded(spatial.cover(tables.points(spark, sf_dir), 0.05, 0.06, 2)[1], 6)


@query()
def geo5_cover_neighbours(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    return spatial.cover_neighbours(p, spatial.cover(p, 0.05, 0.06, 2)[1], 0.06)


@query(_near(0.02) + """, edge AS (SELECT pid_a AS a, pid_b AS b FROM near WHERE pid_a <> pid_b), reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.other),
c AS (SELECT p.pid AS node, coalesce(min(other), p.pid) AS component FROM points p LEFT JOIN reach ON reach.node = p.pid GROUP BY p.pid)
SELECT node, component FROM c WHERE component IN (SELECT component FROM c GROUP BY component HAVING count(*) >= 2)""", "points", recursive=True)
def gra1_components(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    edges = spatial.radius_pairs(p, p, 0.02).select(F.col("pid_a").alias("src"), F.col("pid_b").alias("dst"))
    return graph.components(edges, p.select(F.col("pid").alias("node")), 2)


@query(", d AS (SELECT tree_id, branch, 0 AS depth FROM branch WHERE parent IS NULL UNION ALL SELECT b.tree_id, b.branch, d.depth + 1 FROM branch b JOIN d ON d.tree_id = b.tree_id AND d.branch = b.parent) SELECT tree_id, branch, CAST(depth AS BIGINT) AS depth FROM d", "branch", recursive=True)
def gra3_branch_order(spark, sf_dir):
    return rounded(graph.depths(tables.branches(spark, sf_dir), ["tree_id", "branch"]).drop("root"))


@query(f""", v AS (SELECT branch, sum({V}) AS volume FROM cylinder GROUP BY branch), n AS (SELECT b.tree_id, b.branch, b.parent, coalesce(v.volume, 0) AS volume FROM branch b LEFT JOIN v USING (branch)),
a AS (SELECT tree_id, branch, branch AS above, volume FROM n UNION ALL SELECT a.tree_id, a.branch, n.parent, a.volume FROM a JOIN n ON n.tree_id = a.tree_id AND n.branch = a.above WHERE n.parent IS NOT NULL)
SELECT tree_id, above AS branch, count(*) - 1 AS n_below, round(sum(volume), 4) + 0.0 AS volume_sum FROM a GROUP BY tree_id, above""", "cylinder", recursive=True)
def gra3_subtree_volumes(spark, sf_dir):
    v = tables.cylinders(spark, sf_dir).groupBy("branch").agg(F.sum(tree.volume()).alias("volume"))
    n = tables.branches(spark, sf_dir).join(v, "branch", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return rounded(graph.subtree_sums(n, ["tree_id", "branch"], "volume"))


@query(""", h AS (SELECT tree_id, branch, min_by(sz, position) AS z FROM cylinder GROUP BY ALL), t AS (SELECT tree_id, max(z) AS top, min(z) AS low FROM h GROUP BY tree_id), o AS (SELECT tree_id, max(branch_order) AS top_order FROM branch GROUP BY tree_id)
SELECT b.tree_id, b.branch, CAST(ceil(round(256 * coalesce((top_order - branch_order) / nullif(CAST(top_order AS DOUBLE), 0) * (t.top + 1 - t.low - (h.z - t.low)) / (t.top + 1 - t.low), 1.0), 9)) AS BIGINT) AS size
FROM branch b JOIN o USING (tree_id) JOIN h ON h.branch = b.branch JOIN t ON t.tree_id = b.tree_id""", "cylinder")
def geo7_relative_sizes(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir).where("position = 1").select("tree_id", "branch", "sz")
    t = c.groupBy("tree_id").agg(F.min("sz").alias("_low"), (F.max("sz") + 1 - F.min("sz")).alias("tree_height"))
    return graph.relative_sizes(tables.branches(spark, sf_dir), c.join(t, "tree_id").select("tree_id", "branch", (F.col("sz") - F.col("_low")).alias("height"), "tree_height"))


# The frame of an axis in SQL: at right angles to it and to the coordinate axis that it is least along.
FRAME = """, e AS (SELECT *, CASE WHEN abs(ax) <= abs(ay) AND abs(ax) <= abs(az) THEN 1.0 ELSE 0.0 END AS ex, CASE WHEN NOT (abs(ax) <= abs(ay) AND abs(ax) <= abs(az)) AND abs(ay) <= abs(az) THEN 1.0 ELSE 0.0 END AS ey FROM cylinder),
e2 AS (SELECT *, CASE WHEN ex + ey = 0 THEN 1.0 ELSE 0.0 END AS ez FROM e), v AS (SELECT *, ay * ez - az * ey AS vx, az * ex - ax * ez AS vy, ax * ey - ay * ex AS vz FROM e2),
f AS (SELECT *, vx / sqrt(vx * vx + vy * vy + vz * vz) AS px, vy / sqrt(vx * vx + vy * vy + vz * vz) AS py, vz / sqrt(vx * vx + vy * vy + vz * vz) AS pz FROM v),
q AS (SELECT *, ay * pz - az * py AS qx, az * px - ax * pz AS qy, ax * py - ay * px AS qz, unnest(range(0, 50)) AS k FROM f),
vertex AS (SELECT tree_id, cyl, k, """ + ", ".join(
    f"s{c} + a{c} * length * (CASE WHEN k < 48 THEN floor(k / 24.0) ELSE k - 48 END) + (CASE WHEN k < 48 THEN radius ELSE 0 END) * (cos((k % 24) * 2 * pi() / 24) * p{c} + sin((k % 24) * 2 * pi() / 24) * q{c}) AS {c}" for c in "xyz"
) + " FROM q)"


@query(FRAME + " SELECT tree_id, count(*) AS n, " + ", ".join(f"round(min({c}), 4) + 0.0 AS {c}0, round(max({c}), 4) + 0.0 AS {c}1" for c in "xyz") + " FROM vertex GROUP BY tree_id", "cylinder")
def geo9_mesh_extent(spark, sf_dir):
    v = mesh.cylinder_vertices(tables.cylinders(spark, sf_dir))
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    return rounded(v.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), *ends))


@query("SELECT tree_id, count(*) * 96 AS n_faces, count(*) * 50 AS n_vertices FROM cylinder GROUP BY tree_id", "cylinder")
def geo9_mesh_size(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    faces = mesh.cylinder_faces(c).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_faces"))
    vertices = mesh.cylinder_vertices(c).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    return faces.join(vertices, "tree_id")


FACET = ", facet AS (SELECT tree_id, floor(pid / 3.0) AS fid, " + ", ".join(f"min({c}) AS {c}l, max({c}) AS {c}h" for c in "xyz") + " FROM points GROUP BY ALL)"


@query(FACET + """, b AS (SELECT tree_id, min(xl) AS x0, max(xh) AS x1, min(yl) AS y0, max(yh) AS y1, min(zl) AS z0, max(zh) AS z1 FROM facet GROUP BY tree_id), d AS (SELECT *, unnest(range(0, 7)) AS depth FROM facet JOIN b USING (tree_id)),
i AS (SELECT tree_id, depth, """ + ", ".join(f"least(CAST(floor(({c}l - {c}0) / ({c}1 - {c}0) * pow(2, depth)) AS BIGINT), CAST(pow(2, depth) AS BIGINT) - 1) AS \"b{c}\"" for c in "xyz") + """ FROM d),
c AS (SELECT tree_id, depth, bx, "by", bz, count(*) AS n FROM i GROUP BY ALL), m AS (SELECT tree_id, depth, max(n) AS most FROM c GROUP BY ALL), s AS (SELECT tree_id, coalesce(min(depth) FILTER (WHERE most <= 20), max(depth)) AS depth FROM m GROUP BY tree_id)
SELECT c.tree_id, CAST(c.depth AS BIGINT) AS depth, bx, c."by", bz, n FROM c JOIN s ON s.tree_id = c.tree_id AND s.depth = c.depth""", "points")
def geo12_octree_boxes(spark, sf_dir):
    p = tables.points(spark, sf_dir).withColumn("fid", F.floor(F.col("pid") / 3))
    corner = lambda c, k: F.max(F.when(F.col("pid") % 3 == k - 1, F.col(c))).alias(f"{c}{k}")
    f = p.groupBy("tree_id", "fid").agg(*[corner(c, k) for c in "xyz" for k in (1, 2, 3)])
    return rounded(mesh.octree_boxes(f, 20, 6))


@query(""", c AS (SELECT *, position / CAST(max(position) OVER (PARTITION BY branch) AS DOUBLE) AS rel, (sz - min(sz) OVER t) / nullif(max(sz) OVER t - min(sz) OVER t, 0) AS h FROM cylinder WINDOW t AS (PARTITION BY tree_id)),
w AS (SELECT *, greatest((rel - (0.95 - 0.25 * least(branch_order, 4) / 4.0)) / (1 - (0.95 - 0.25 * least(branch_order, 4) / 4.0)), 0) * (0.2 + 0.8 * coalesce(h, 0)) AS weight FROM c)
SELECT tree_id, cyl, round(weight / sum(weight) OVER (PARTITION BY tree_id), 6) + 0.0 AS density FROM w""", "cylinder")
def lea1_leaf_density(spark, sf_dir):
    from pyspark.sql import Window

    t = Window.partitionBy("tree_id")
    last = F.max("position").over(Window.partitionBy("branch"))
    h = (F.col("sz") - F.min("sz").over(t)) / F.nullif(F.max("sz").over(t) - F.min("sz").over(t), F.lit(0.0))
    blocks = tables.cylinders(spark, sf_dir).select("tree_id", "cyl", "branch_order", (F.col("position") / last).alias("position"), F.coalesce(h, F.lit(0.0)).alias("height"))
    return rounded(mesh.leaf_density(blocks).select("tree_id", "cyl", "density"), 6)


@query()
def gra2_segments(spark, sf_dir):
    """Tested on a synthetic tree."""
    p = tables.points(spark, sf_dir)
    members = spatial.cover(p, 0.08, 0.1, 1)[1]
    return segmentation.segments(p, members, spatial.cover_neighbours(p, members, 0.1), base_band=0.1).select("tree_id", "centre", "layer", "segment", "parent_segment")


@query()
def fit5_cylinders(spark, sf_dir):
    """Tested on a synthetic tree."""
    p = tables.points(spark, sf_dir)
    members = spatial.cover(p, 0.08, 0.1, 1)[1]
    s = segmentation.segments(p, members, spatial.cover_neighbours(p, members, 0.1), base_band=0.1)
    return rounded(segmentation.cylinders(p, members, s, layers=3))
