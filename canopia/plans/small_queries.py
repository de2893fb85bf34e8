"""Further joins, functions, statistics and crown measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.functions import names, rounding, vectors
from canopia.operators import crown, mesh, runs, spatial, tree
from canopia.plans.oracle import off_ties, with_tables
from canopia.plans.tree_queries import A, V
from canopia.plans.tree_queries import rounded as rounded_to
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, *names_: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_tables(off_ties(sql), *names_, recursive=recursive)
        return f

    return add


def rounded(df, digits: int = 4):
    return rounded_to(df, digits, off_ties=True)


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY pid) AS k FROM points), c AS (SELECT a.tree_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM k a JOIN k b ON b.tree_id = a.tree_id WHERE a.k = 1 AND b.k = 2)
SELECT c.tree_id, CAST(1 AS BIGINT) AS box, p.pid FROM c JOIN points p ON p.tree_id = c.tree_id WHERE floor(p.x / 0.05) BETWEEN least(floor(x0 / 0.05), floor(x1 / 0.05)) - 1 AND greatest(floor(x0 / 0.05), floor(x1 / 0.05)) + 1
AND floor(p.y / 0.05) BETWEEN least(floor(y0 / 0.05), floor(y1 / 0.05)) - 1 AND greatest(floor(y0 / 0.05), floor(y1 / 0.05)) + 1 AND floor(p.z / 0.05) BETWEEN least(floor(z0 / 0.05), floor(z1 / 0.05)) - 1 AND greatest(floor(z0 / 0.05), floor(z1 / 0.05)) + 1""", "points")
def joi5_box_of_corners(spark, sf_dir):
    """Points up to a cell beside the box that each cloud's first two points span."""
    p = tables.points(spark, sf_dir)
    two = p.groupBy("tree_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pid", "x", "y", "z"))), 1, 2).alias("_p"))
    corners = two.select("tree_id", F.lit(1).cast("long").alias("box"), *[F.get("_p", F.lit(k))[c].alias(f"{c}{k}") for k in (0, 1) for c in "xyz"])
    return spatial.box_neighbourhood(p, corners, 0.05, 1)


@query(""", d AS (SELECT a.tree_id, a.pid AS pid_a, b.pid AS pid_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM points a JOIN points b ON b.tree_id = a.tree_id WHERE a.pid % 2 = 0 AND b.pid % 2 = 1)
SELECT tree_id, round(min(dist), 6) + 0.0 AS dist FROM d GROUP BY tree_id""", "points")
def joi4_nearest_between_sets(spark, sf_dir):
    """The nearest pair of an even and an odd point of each cloud."""
    p = tables.points(spark, sf_dir)
    return rounded(spatial.nearest_between(p.where("pid % 2 = 0"), p.where("pid % 2 = 1"), 0.02).select("tree_id", "dist"), 6)


@query(" SELECT file FROM run EXCEPT SELECT file FROM run WHERE height > 12", "run")
def joi12_not_done(spark, sf_dir):
    r = tables.runs(spark, sf_dir)
    return runs.not_done(r.select("file"), r.where("height > 12"))


@query(""" SELECT file, regexp_replace(file, '[.][^./]*$', '') AS stem, CASE WHEN file LIKE '%-0.mat' THEN left(file, length(file) - 6) ELSE file END AS without_first, regexp_replace(file, '[.][^./]*$', '') || '.ply' AS as_ply FROM run""", "run")
def fun12_suffixes(spark, sf_dir):
    f = F.col("file")
    return tables.runs(spark, sf_dir).select("file", names.without_suffix(f).alias("stem"), names.without_suffix(f, "-0.mat").alias("without_first"), names.with_suffix(names.without_suffix(f), ".ply").alias("as_ply"))


@query("SELECT tree_id, round(max(x) + ((max(x) % 0.3) + 0.3) % 0.3, 6) + 0.0 AS high, round(min(x) - ((min(x) % 0.3) + 0.3) % 0.3, 6) + 0.0 AS low FROM points GROUP BY tree_id", "points")
def fun17_axis_ends(spark, sf_dir):
    return rounded(tables.points(spark, sf_dir).groupBy("tree_id").agg(rounding.axis_end(F.max("x"), 0.3).alias("high"), rounding.axis_end(F.min("x"), 0.3, up=False).alias("low")), 6)


@query(""", m AS (SELECT tree_id, pid, x * 4000 * (tree_id % 2 * 5 + 1) AS x, y * 4000 * (tree_id % 2 * 5 + 1) AS y, z * 4000 * (tree_id % 2 * 5 + 1) AS z FROM points), e AS (SELECT tree_id, max(z) - min(z) AS extent FROM m GROUP BY tree_id)
SELECT tree_id, pid, round(CASE WHEN extent > 3000 THEN x / 3000 ELSE x END, 4) + 0.0 AS x, round(CASE WHEN extent > 3000 THEN y / 3000 ELSE y END, 4) + 0.0 AS y, round(CASE WHEN extent > 3000 THEN z / 3000 ELSE z END, 4) + 0.0 AS z FROM m JOIN e USING (tree_id)""", "points")
def fil7_metres(spark, sf_dir):
    """Clouds in mixed units, told by their height; three columns stay."""
    k = (F.col("tree_id") % 2 * 5 + 1) * 4000
    p = tables.points(spark, sf_dir).select("tree_id", "pid", *[(F.col(c) * k).alias(c) for c in "xyz"])
    extent = p.groupBy("tree_id").agg((F.max("z") - F.min("z")).alias("extent"))
    return rounded(p.join(extent, "tree_id").select("tree_id", "pid", *[rounding.metres(F.col(c), F.col("extent"), 3000.0).alias(c) for c in "xyz"]))


@query(""", q AS (SELECT c.tree_id, c.cyl, c.sx - p.sx AS dx, c.sy - p.sy AS dy, c.sz - p.sz AS dz, p.ax, p.ay, p.az, p.sx AS px, p.sy AS py, p.sz AS pz FROM cylinder c JOIN cylinder p ON p.tree_id = c.tree_id AND p.cyl = c.parent),
h AS (SELECT *, dx * ax + dy * ay + dz * az AS h FROM q), v AS (SELECT *, dx - h * ax AS vx, dy - h * ay AS vy, dz - h * az AS vz FROM h)
SELECT tree_id, cyl, round(sqrt(vx * vx + vy * vy + vz * vz), 4) + 0.0 AS dist, round(h, 4) + 0.0 AS height, round(vx, 4) + 0.0 AS vx, round(vy, 4) + 0.0 AS vy, round(vz, 4) + 0.0 AS vz, round(px + h * ax, 4) + 0.0 AS bx, round(py + h * ay, 4) + 0.0 AS b_y, round(pz + h * az, 4) + 0.0 AS bz FROM v""", "cylinder")
def fun2_line_foot(spark, sf_dir):
    """Each start seen from the axis of its parent cylinder: distance, height, vector at right angles, foot."""
    c = tables.cylinders(spark, sf_dir)
    up = c.select("tree_id", F.col("cyl").alias("parent"), *[F.col(x).alias(f"p{x}") for x in ("sx", "sy", "sz", "ax", "ay", "az")])
    d, v, h, foot = vectors.line_foot(vectors.vector("sx", "sy", "sz"), vectors.vector("psx", "psy", "psz"), vectors.vector("pax", "pay", "paz"))
    out = c.join(up, ["tree_id", "parent"])
    return rounded(out.select("tree_id", "cyl", d.alias("dist"), h.alias("height"), *[x.alias(n) for n, x in zip(("vx", "vy", "vz"), v, strict=True)], *[x.alias(n) for n, x in zip(("bx", "b_y", "bz"), foot, strict=True)]))


PARENT = """, q AS (SELECT c.tree_id, c.cyl, c.ax, c.ay, c.az, p.ax AS px, p.ay AS py, p.az AS pz FROM cylinder c JOIN cylinder p ON p.tree_id = c.tree_id AND p.cyl = c.parent), x AS (SELECT *, ay * pz - az * py AS cx, az * px - ax * pz AS cy, ax * py - ay * px AS cz, ax * px + ay * py + az * pz AS d FROM q)"""


def _with_parent(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    up = c.select("tree_id", F.col("cyl").alias("parent"), *[F.col(f"a{n}").alias(f"p{n}") for n in "xyz"])
    return c.join(up, ["tree_id", "parent"])


@query(PARENT + " SELECT tree_id, cyl, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round(d, 6) + 0.0 AS d FROM x", "cylinder")
def fun1_products(spark, sf_dir):
    """Cross and dot products of each cylinder's axis with its parent's."""
    a, b = vectors.vector("ax", "ay", "az"), vectors.vector("px", "py", "pz")
    return rounded(_with_parent(spark, sf_dir).select("tree_id", "cyl", *[x.alias(f"c{n}") for n, x in zip("xyz", vectors.cross(a, b), strict=True)], vectors.dot(a, b).alias("d")), 6)


@query(PARENT + """ SELECT tree_id, cyl, round(px * cos(0.7) + cx * sin(0.7) + ax * d * (1 - cos(0.7)), 6) + 0.0 AS rx, round(py * cos(0.7) + cy * sin(0.7) + ay * d * (1 - cos(0.7)), 6) + 0.0 AS ry,
  round(pz * cos(0.7) + cz * sin(0.7) + az * d * (1 - cos(0.7)), 6) + 0.0 AS rz FROM x""", "cylinder")
def fun3_turned_axis(spark, sf_dir):
    """The parent's axis turned by 0.7 about each cylinder's own."""
    m = vectors.rotation_matrix(vectors.vector("ax", "ay", "az"), F.lit(0.7))
    p = vectors.vector("px", "py", "pz")
    return rounded(_with_parent(spark, sf_dir).select("tree_id", "cyl", *[vectors.dot(row, p).alias(f"r{n}") for n, row in zip("xyz", m, strict=True)]), 6)


@query(" SELECT 'site_' || file AS cloud, split_part(split_part('site_' || file, '.', 1), '_', 3) AS tree FROM run", "run")
def fun9_tree_of_cloud(spark, sf_dir):
    r = tables.runs(spark, sf_dir).select(F.concat(F.lit("site_"), "file").alias("cloud"))
    return r.select("cloud", names.tree_number(F.col("cloud")).alias("tree"))


COV = """, c AS (SELECT tree_id, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM points GROUP BY tree_id),
p AS (SELECT *, (xx + yy + zz) / 3 AS mean, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM c),
b AS (SELECT *, (xx - mean) / p AS ba, (yy - mean) / p AS bb, (zz - mean) / p AS bc, xy / p AS bd, xz / p AS be, yz / p AS bf FROM p), r AS (SELECT *, acos(least(greatest((ba * (bb * bc - bf * bf) - bd * (bd * bc - bf * be) + be * (bd * bf - bb * be)) / 2, -1), 1)) / 3 AS angle FROM b),
e AS (SELECT *, mean + 2 * p * cos(angle) AS e1, mean + 2 * p * cos(angle + 2.0943951023931953) AS e3 FROM r)"""


def _covariances(spark, sf_dir):
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    return tables.points(spark, sf_dir).groupBy("tree_id").agg(*[F.covar_samp(p[0], p[1]).alias(p) for p in pairs]), [F.col(p) for p in pairs]


@query(COV + " SELECT tree_id, round((e1 - (3 * mean - e1 - e3)) / e1, 4) + 0.0 AS linear, round(((3 * mean - e1 - e3) - e3) / e1, 4) + 0.0 AS planar, round(e3 / e1, 4) + 0.0 AS scattered, (e1 - (3 * mean - e1 - e3)) / e1 > 0.85 AS is_line FROM e", "points")
def agg26_shape(spark, sf_dir):
    """How far a cloud is a line, a plane or neither, from the eigenvalues of its covariance."""
    c, m = _covariances(spark, sf_dir)
    e1, e2, e3 = vectors.eigenvalues(*m)
    return rounded(c.select("tree_id", ((e1 - e2) / e1).alias("linear"), ((e2 - e3) / e1).alias("planar"), (e3 / e1).alias("scattered"), ((e1 - e2) / e1 > 0.85).alias("is_line")))


def _directions(by: str, names: list[str], extra: str = "") -> str:
    """Eigenvectors of the covariances of groups, in SQL: the longest cross product of two rows of the shifted matrix."""
    v = """, g AS (SELECT {by}, count(*) AS n_points, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM points GROUP BY ALL),
p AS (SELECT *, (xx + yy + zz) / 3 AS mean, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM g),
b AS (SELECT *, coalesce((xx - mean) / nullif(p, 0), 0) AS ba, coalesce((yy - mean) / nullif(p, 0), 0) AS bb, coalesce((zz - mean) / nullif(p, 0), 0) AS bc, coalesce(xy / nullif(p, 0), 0) AS bd, coalesce(xz / nullif(p, 0), 0) AS be, coalesce(yz / nullif(p, 0), 0) AS bf FROM p),
r AS (SELECT *, acos(least(greatest((ba * (bb * bc - bf * bf) - bd * (bd * bc - bf * be) + be * (bd * bf - bb * be)) / 2, -1), 1)) / 3 AS angle FROM b),
e AS (SELECT *, mean + 2 * p * cos(angle) AS along, mean + 2 * p * cos(angle + 2.0943951023931953) AS across FROM r)""".replace("{by}", by)
    last = "e"
    for k in ("along", "across"):
        rows = [(f"xx - {k}", "xy", "xz"), ("xy", f"yy - {k}", "yz"), ("xz", "yz", f"zz - {k}")]
        sides = [[f"({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))] for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
        v += f", {k}1 AS (SELECT *, " + ", ".join(f"{side[i]} AS s{j}{c}" for j, side in enumerate(sides) for i, c in enumerate("xyz")) + f" FROM {last})"
        v += f", {k}2 AS (SELECT *, " + ", ".join(f"s{j}x * s{j}x + s{j}y * s{j}y + s{j}z * s{j}z AS n{j}" for j in range(3)) + f" FROM {k}1)"
        v += f", {k}3 AS (SELECT *, " + ", ".join(f"CASE WHEN n0 = greatest(n0, n1, n2) THEN s0{c} WHEN n1 = greatest(n0, n1, n2) THEN s1{c} ELSE s2{c} END AS v{c}" for c in "xyz") + f" FROM {k}2)"
        v += f", {k}4 AS (SELECT *, nullif(sqrt(vx * vx + vy * vy + vz * vz), 0) * CASE WHEN abs(vx) = greatest(abs(vx), abs(vy), abs(vz)) THEN sign(vx) WHEN abs(vy) = greatest(abs(vx), abs(vy), abs(vz)) THEN sign(vy) ELSE sign(vz) END AS size FROM {k}3)"
        v += f", {k}5 AS (SELECT * EXCLUDE (size, vx, vy, vz, n0, n1, n2, s0x, s0y, s0z, s1x, s1y, s1z, s2x, s2y, s2z), " + ", ".join(f"vx / size AS {k}_x, vy / size AS {k}_y, vz / size AS {k}_z".split(", ")) + f" FROM {k}4)"
        last = f"{k}5"
    vectors_ = ", ".join(f"round({k}_{c}, 4) + 0.0 AS {k}_{c}" for k in ("along", "across") for c in "xyz")
    return f"{v} SELECT {', '.join(names)}, {extra}{vectors_} FROM {last}"


@query(_directions("tree_id", ["tree_id"]), "points")
def fun5_main_directions(spark, sf_dir):
    """Unit vectors most along and most across each cloud; a test compares them with a numerical eigensolver."""
    return rounded(spatial.main_directions(tables.points(spark, sf_dir)))


SHARE = "round({} / nullif(along, 0), 4) + 0.0 AS {}, "
SHAPES = "n_points, " + SHARE.format("(along - (3 * mean - along - across))", "linear") + SHARE.format("((3 * mean - along - across) - across)", "planar") + SHARE.format("across", "scattered")


@query(_directions("tree_id, " + ", ".join(f"CAST(floor({c} / 0.25) AS BIGINT) AS c{c}" for c in "xyz"), ["tree_id", "cx", "cy", "cz"], SHAPES), "points")
def old7_set_shapes(spark, sf_dir):
    """Shape and main directions of every set of points, the sets being cells of 25 cm."""
    p = tables.points(spark, sf_dir).withColumns({f"c{c}": F.floor(F.col(c) / 0.25).cast("long") for c in "xyz"})
    return rounded(spatial.main_directions(p, ("tree_id", "cx", "cy", "cz"), shape=True))


@query(""", n AS (SELECT tree_id, CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, count(*) AS n FROM points GROUP BY ALL), d AS (SELECT tree_id, cx + i AS cx, cy + j AS cy, sum(n) / 9.0 AS mean FROM n, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b GROUP BY ALL),
k AS (SELECT d.*, row_number() OVER (PARTITION BY d.tree_id ORDER BY round(mean, 9) DESC, d.cx, d.cy) AS k FROM d JOIN n ON n.tree_id = d.tree_id AND n.cx = d.cx AND n.cy = d.cy) SELECT tree_id, cx, cy, round(mean, 4) + 0.0 AS mean FROM k WHERE k = 1""", "points")
def win12_densest_place(spark, sf_dir):
    return rounded(crown.densest_place(crown.raster_counts(tables.points(spark, sf_dir), 0.05)))


@query(""", m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my, min(z) AS z0, max(z) AS z1 FROM points GROUP BY tree_id),
s AS (SELECT tree_id, CAST(least(floor((z - z0) / (z1 - z0) * 10), 9) AS BIGINT) AS layer, least(CAST(floor(round((atan2(y - my, x - mx) + pi()) / (2 * pi()) * 12, 9)) AS BIGINT), 11) AS s, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS r FROM points JOIN m USING (tree_id) WHERE z1 > z0 GROUP BY ALL),
w AS (SELECT tree_id, layer, s % 6 AS d, sum(r) AS w, count(*) AS n FROM s GROUP BY ALL) SELECT tree_id, layer, round(min(w), 4) + 0.0 AS least, round(avg(w), 4) + 0.0 AS mean, round(max(w), 4) + 0.0 AS most FROM w WHERE n = 2 GROUP BY ALL""", "points")
def agg30_layer_diameters(spark, sf_dir):
    return rounded(crown.layer_diameters(tables.points(spark, sf_dir)))


@query(f""", v AS (SELECT tree_id % 25 AS run, CAST(least(ceil(round(radius * 200, 9)), 41) AS BIGINT) AS size_class, sum({V}) / count(DISTINCT tree_id) AS volume FROM cylinder GROUP BY ALL)
SELECT run, size_class, round(volume, 4) + 0.0 AS volume, round(volume - first_value(volume) OVER (PARTITION BY size_class ORDER BY run), 4) + 0.0 AS to_first FROM v""", "cylinder")
def agg27_difference_to_first(spark, sf_dir):
    """Mean volume of each diameter class in each run, and how far it is from that of the first run that has the class."""
    from pyspark.sql import Window

    c = tables.cylinders(spark, sf_dir).withColumns({"run": F.col("tree_id") % 25, "size_class": F.least(F.ceil(F.round(F.col("radius") * 200, 9)), F.lit(41))})
    v = c.groupBy("run", "size_class").agg((F.sum(tree.volume()) / F.countDistinct("tree_id")).alias("volume"))
    return rounded(v.withColumn("to_first", F.col("volume") - F.first("volume").over(Window.partitionBy("size_class").orderBy("run"))))


@query(f""", b AS (SELECT tree_id, branch, branch_order, min_by(sz, position) AS z, sum({V}) AS volume FROM cylinder GROUP BY ALL), h AS (SELECT *, CAST(floor(round((z - min(z) OVER (PARTITION BY tree_id)) / 0.5, 6)) AS BIGINT) AS bin FROM b)
SELECT tree_id, bin, count(*) FILTER (WHERE branch_order > 0) AS n, count(*) FILTER (WHERE branch_order = 1) AS n_1, round(sum(CASE WHEN branch_order > 0 THEN volume ELSE 0 END), 4) + 0.0 AS volume FROM h GROUP BY ALL""", "cylinder")
def agg31_height_frequency(spark, sf_dir):
    """Branches by half a metre of height."""
    b = tree.branch_table(tables.cylinders(spark, sf_dir)).withColumn("bin", F.floor(F.round(F.col("height") / 0.5, 6)))
    some = F.col("branch_order") > 0
    return rounded(b.groupBy("tree_id", "bin").agg(F.count_if(some).alias("n"), F.count_if(F.col("branch_order") == 1).alias("n_1"), F.sum(F.when(some, F.col("volume")).otherwise(0.0)).alias("volume")))


@query(f""", o AS (SELECT tree_id, CAST(branch_order AS BIGINT) AS branch_order, count(DISTINCT branch) AS n_branches, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length FROM cylinder GROUP BY ALL)
SELECT tree_id, branch_order, n_branches, round(volume, 4) + 0.0 AS volume, round(area, 4) + 0.0 AS area, round(length, 4) + 0.0 AS length, round(100 * volume / sum(volume) OVER (PARTITION BY tree_id), 4) + 0.0 AS volume_pct FROM o""", "cylinder")
def old15_orders_with_trunk(spark, sf_dir):
    from pyspark.sql import Window

    o = tables.cylinders(spark, sf_dir).groupBy("tree_id", "branch_order").agg(F.countDistinct("branch").alias("n_branches"), F.sum(tree.volume()).alias("volume"), F.sum(tree.area()).alias("area"), F.sum("length").alias("length"))
    return rounded(o.withColumn("volume_pct", F.col("volume") * 100 / F.sum("volume").over(Window.partitionBy("tree_id"))))


@query()
def geo10_surface_grid(spark, sf_dir):
    """10 x 10 places on each trunk cylinder; a test checks their distance from the axis."""
    return rounded(mesh.cylinder_grid(tables.cylinders(spark, sf_dir).where("branch_order = 0"), 10))


@query()
def geo15_crown_cloud(spark, sf_dir):
    """A test checks the numbers of points and their distance from the axes."""
    return rounded(crown.surface_points(tables.cylinders(spark, sf_dir)))


BASE = f""", along AS (SELECT tree_id, cyl, radius, sum(length) OVER (PARTITION BY tree_id ORDER BY cyl) AS so_far FROM cylinder), dbh AS (SELECT tree_id, 2 * min_by(radius, cyl) FILTER (WHERE so_far >= 1.3) AS d FROM along GROUP BY tree_id),
e AS (SELECT tree_id, branch, branch_order, min_by(sx, position) AS x0, min_by(sy, position) AS y0, min_by(sz, position) AS z0, min_by(radius, position) AS r, min_by(coalesce(parent, -1), position) AS up, max_by(sx + length * ax, position) AS x1, max_by(sy + length * ay, position) AS y1,
  min(least(sz, sz + length * az)) AS low FROM cylinder GROUP BY ALL),
f AS (SELECT e.*, d, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / d * 2 AS reach FROM e JOIN dbh USING (tree_id) WHERE branch_order = 1), md AS (SELECT tree_id, least(10, median(reach)) AS m FROM f GROUP BY tree_id),
g AS (SELECT f.*, row_number() OVER (PARTITION BY f.tree_id ORDER BY coalesce(NOT (2 * r > least(0.05, 0.05 * d) AND reach > m), true), z0, branch) AS k FROM f JOIN md USING (tree_id)),
pb AS (SELECT e.tree_id, e.branch, e.low, c.branch AS parent FROM e LEFT JOIN cylinder c ON c.tree_id = e.tree_id AND c.cyl = e.up),
below AS (SELECT tree_id, branch FROM g WHERE k = 1 UNION SELECT pb.tree_id, pb.branch FROM below b JOIN pb ON pb.tree_id = b.tree_id AND pb.parent = b.branch),
base AS (SELECT tree_id, min(low) - (SELECT min_by(sz, cyl) FROM cylinder c WHERE c.tree_id = below.tree_id) AS crown_base FROM below JOIN pb USING (tree_id, branch) GROUP BY tree_id),
top AS (SELECT tree_id, max(sz) + max_by(greatest(length * az, 0.0), sz) - min(sz) AS height FROM cylinder GROUP BY tree_id)"""


def _base(spark, sf_dir):
    c = tables.stored_cylinders(spark, sf_dir)
    return crown.crown_base(c, tree.breast_diameter(c)).join(tree.height(c), "tree_id")


@query(BASE + " SELECT tree_id, round(crown_base, 4) + 0.0 AS crown_base, round(height - crown_base, 4) + 0.0 AS crown_length, round((height - crown_base) / nullif(height, 0), 4) + 0.0 AS crown_ratio FROM base JOIN top USING (tree_id)", "cylinder", recursive=True)
def geo17_crown_base(spark, sf_dir):
    length = F.col("height") - F.col("crown_base")
    return rounded(_base(spark, sf_dir).select("tree_id", "crown_base", length.alias("crown_length"), (length / F.nullif(F.col("height"), F.lit(0.0))).alias("crown_ratio")))


@query(BASE + " SELECT tree_id, round(crown_base / nullif(height, 0), 4) + 0.0 AS crown_start_height, round((height - crown_base) / nullif(height, 0), 4) + 0.0 AS crown_height FROM base JOIN top USING (tree_id)", "cylinder", recursive=True)
def fea1f_crown_heights(spark, sf_dir):
    ratio = lambda x: x / F.nullif(F.col("height"), F.lit(0.0))
    return rounded(_base(spark, sf_dir).select("tree_id", ratio(F.col("crown_base")).alias("crown_start_height"), ratio(F.col("height") - F.col("crown_base")).alias("crown_height")))


MANY = ["total_volume", "trunk_volume", "branch_volume", "trunk_length", "branch_length", "area", "n_branches", "max_order", "n_cylinders"]
MAGNITUDE = "CASE WHEN abs({0}) > 100 THEN round({0} + 0.000017, 0) WHEN abs({0}) > 10 THEN round({0} + 0.000017, 1) WHEN abs({0}) > 1 THEN round({0} + 0.000017, 2) ELSE round({0} + 0.000017, 3) END + 0.0"
LONG = " UNION ALL ".join(f"SELECT tree_id % 25 AS run, '{c}' AS attribute, CAST({c} AS DOUBLE) AS v FROM t" for c in MANY)


@query(f""", t AS (SELECT tree_id, sum({V}) AS total_volume, sum(CASE WHEN branch_order = 0 THEN {V} ELSE 0 END) AS trunk_volume, sum(CASE WHEN branch_order > 0 THEN {V} ELSE 0 END) AS branch_volume, sum(CASE WHEN branch_order = 0 THEN length ELSE 0 END) AS trunk_length,
  sum(CASE WHEN branch_order > 0 THEN length ELSE 0 END) AS branch_length, sum({A}) AS area, count(DISTINCT branch) AS n_branches, max(branch_order) AS max_order, count(*) AS n_cylinders FROM cylinder GROUP BY tree_id), l AS ({LONG}),
s AS (SELECT run, attribute, avg(v) AS mean, min(v) AS least, max(v) AS most, stddev_samp(v) AS sd, 100 * stddev_samp(v) / nullif(avg(v), 0) AS cv_pct FROM l GROUP BY ALL)
SELECT run, attribute, """ + ", ".join(f"{MAGNITUDE.format(c)} AS {c}" for c in ("mean", "least", "most", "sd", "cv_pct")) + " FROM s", "cylinder")
def agg17_all_attributes(spark, sf_dir):
    """Mean, least, most, deviation and its share over the models of a run, rounded by their size."""
    t = tree.totals(tables.cylinders(spark, sf_dir)).withColumn("run", F.col("tree_id") % 25)
    long = t.select("run", *[F.col(c).cast("double").alias(c) for c in MANY]).unpivot(["run"], MANY, "attribute", "v")
    s = long.groupBy("run", "attribute").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.stddev_samp("v").alias("sd"), (F.stddev_samp("v") * 100 / F.nullif(F.avg("v"), F.lit(0.0))).alias("cv_pct"))
    shifted = lambda c: F.when(F.abs(c) > 100, F.round(F.col(c) + 0.000017, 0)).when(F.abs(c) > 10, F.round(F.col(c) + 0.000017, 1)).when(F.abs(c) > 1, F.round(F.col(c) + 0.000017, 2)).otherwise(F.round(F.col(c) + 0.000017, 3)) + 0.0
    return s.select("run", "attribute", *[shifted(c).alias(c) for c in ("mean", "least", "most", "sd", "cv_pct")])


@query()
def fil3_greedy_density(spark, sf_dir):
    """A test compares it with the walk over the points."""
    return spatial.greedy_density_filter(tables.points(spark, sf_dir), 0.1, 3)


@query()
def fil6_component_filter(spark, sf_dir):
    """A test compares it with components of the cover sets."""
    return spatial.component_filter(tables.points(spark, sf_dir), 0.1, 3).select("tree_id", "pid")


@query()
def old6_extended_sets(spark, sf_dir):
    """Each cover set with its neighbours' points."""
    p = tables.points(spark, sf_dir)
    _, members = spatial.cover(p, 0.1, 0.12, 1)
    return spatial.extended_sets(members, spatial.cover_neighbours(p, members, 0.12))
