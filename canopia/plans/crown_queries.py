"""Queries over crowns, candidate joins and further distributions, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopia.functions.vectors import line_distance, vector
from canopia.operators import crown, features, tree
from canopia.plans.feature_queries import BRANCHES, _branches
from canopia.plans.oracle import with_tables
from canopia.plans.tree_queries import V, A, rounded
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_tables(sql, *names)
        return f

    return add


MEANS = ", m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my, min(z) AS z0, max(z) AS z1 FROM points GROUP BY tree_id)"


def _sector(n: int) -> str:
    return f"CAST(least(floor(round((atan2(y - my, x - mx) + pi()) / (2 * pi()) * {n}, 9)), {n - 1}) AS BIGINT)"


@query(MEANS + f""", c AS (SELECT DISTINCT tree_id, {_sector(16)} AS s, least(floor((z - z0) / (z1 - z0) * 3), 2) AS p FROM points JOIN m USING (tree_id)), r AS (SELECT DISTINCT tree_id, s FROM c),
o AS (SELECT a.tree_id, max(CASE WHEN b.s IS NOT NULL THEN 1 ELSE 0 END) = 1 AS opposite FROM r a LEFT JOIN r b ON b.tree_id = a.tree_id AND b.s = (a.s + 8) % 16 GROUP BY a.tree_id)
SELECT c.tree_id, round(count(*) / 48.0, 4) + 0.0 AS cover, any_value(opposite) AS opposite FROM c JOIN o ON o.tree_id = c.tree_id GROUP BY c.tree_id""", "points")
def agg32_surface_cover(spark, sf_dir):
    return rounded(crown.surface_cover(tables.points(spark, sf_dir)))


@query(MEANS + f""", s AS (SELECT tree_id, CAST(least(floor((z - z0) / (z1 - z0) * 20), 19) AS BIGINT) AS layer, {_sector(36)} AS s, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS r FROM points JOIN m USING (tree_id) GROUP BY ALL)
SELECT tree_id, layer, s % 18 AS direction, round(sum(r), 4) + 0.0 AS spread FROM s GROUP BY ALL""", "points")
def geo16_spreads(spark, sf_dir):
    return rounded(crown.spreads(tables.points(spark, sf_dir)))


@query()
def geo13_hulls(spark, sf_dir):
    """Tested against a hull over all points."""
    return rounded(crown.hulls(tables.points(spark, sf_dir)))


@query(""", c AS (SELECT tree_id, CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, count(*) AS n FROM points GROUP BY ALL)
SELECT a.tree_id, a.cx, a.cy, round(sum(b.n) / 9.0, 4) + 0.0 AS mean FROM c a JOIN c b ON b.tree_id = a.tree_id AND abs(b.cx - a.cx) <= 1 AND abs(b.cy - a.cy) <= 1 GROUP BY a.tree_id, a.cx, a.cy""", "points")
def win12_smoothed_raster(spark, sf_dir):
    return rounded(crown.smoothed(crown.raster_counts(tables.points(spark, sf_dir), 0.05)))


@query(MEANS + """, l AS (SELECT tree_id, CAST(least(floor((z - z0) / (z1 - z0) * 10), 9) AS BIGINT) AS layer, 2 * avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS d FROM points JOIN m USING (tree_id) GROUP BY ALL),
b AS (SELECT *, coalesce(d >= 1.25 * lag(d, 1) OVER w, false) OR coalesce(d >= 1.25 * lag(d, 2) OVER w, false) AS big FROM l WINDOW w AS (PARTITION BY tree_id ORDER BY layer)),
c AS (SELECT *, max(CASE WHEN big THEN 1 ELSE 0 END) OVER (PARTITION BY tree_id ORDER BY layer) AS any_big FROM b) SELECT tree_id, layer, round(d, 4) + 0.0 AS diameter FROM c WHERE any_big = 0""", "points")
def win11_until_blow_up(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    m = p.groupBy("tree_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    far = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    layer = F.least(F.floor((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")) * 10), F.lit(9)).cast("long")
    return rounded(crown.until_blow_up(p.join(m, "tree_id").groupBy("tree_id", layer.alias("layer")).agg((F.avg(far) * 2).alias("diameter"))))


@query("SELECT tree_id, pid FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.tree_id = p.tree_id AND q.pid = p.pid AND q.z > 0)", "points")
def fil9_cloud_difference(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    return p.join(p.where("z > 0"), ["tree_id", "pid"], "left_anti").select("tree_id", "pid")


@query("SELECT tree_id, pid, CASE greatest(x, y, z) WHEN x THEN 1 WHEN y THEN 2 ELSE 3 END AS class FROM points", "points")
def fil10_largest_column(spark, sf_dir):
    top = F.greatest("x", "y", "z")
    return tables.points(spark, sf_dir).select("tree_id", "pid", F.when(F.col("x") == top, 1).when(F.col("y") == top, 2).otherwise(3).alias("class"))


@query(f"SELECT tree_id, round(sum(CASE WHEN radius > 0.05 THEN {V} ELSE 0 END), 4) + 0.0 AS thick, round(sum(CASE WHEN radius > 0.025 AND radius <= 0.05 THEN {V} ELSE 0 END), 4) + 0.0 AS middle, round(sum(CASE WHEN radius <= 0.025 THEN {V} ELSE 0 END), 4) + 0.0 AS thin FROM cylinder GROUP BY tree_id", "cylinder")
def fil8_partial_volumes(spark, sf_dir):
    v, r = tree.volume(), F.col("radius")
    part = lambda c: F.sum(F.when(c, v).otherwise(0.0))
    return rounded(tables.cylinders(spark, sf_dir).groupBy("tree_id").agg(part(r > 0.05).alias("thick"), part((r > 0.025) & (r <= 0.05)).alias("middle"), part(r <= 0.025).alias("thin")))


CANDIDATES = """, f AS (SELECT c.tree_id, c.branch, c.cyl, c.sx, c.sy, c.sz, c.ax, c.ay, c.az, b.parent AS above FROM cylinder c JOIN branch b ON b.branch = c.branch WHERE c.position = 1 AND b.parent IS NOT NULL),
k AS (SELECT f.tree_id, f.branch, p.cyl AS candidate, p.radius, f.sx - p.sx AS dx, f.sy - p.sy AS dy, f.sz - p.sz AS dz, f.ax, f.ay, f.az, p.ax AS px, p.ay AS py, p.az AS pz,
  sqrt((f.sx - p.sx) * (f.sx - p.sx) + (f.sy - p.sy) * (f.sy - p.sy) + (f.sz - p.sz) * (f.sz - p.sz)) AS dist FROM f JOIN cylinder p ON p.branch = f.above),
r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY round(dist, 9), candidate) AS k FROM k)"""


def _candidates(spark, sf_dir, n: int = 4):
    """The ``n`` cylinders of the parent branch whose starts are nearest to a branch's first."""
    c = tables.cylinders(spark, sf_dir)
    up = tables.branches(spark, sf_dir).where(F.col("parent").isNotNull()).select("branch", F.col("parent").alias("above"))
    f = c.where("position = 1").join(up, "branch").select("tree_id", "branch", "above", *[F.col(k) for k in ("sx", "sy", "sz", "ax", "ay", "az")])
    p = c.select(F.col("branch").alias("above"), F.col("cyl").alias("candidate"), "radius", *[F.col(k).alias(f"p{k}") for k in ("sx", "sy", "sz", "ax", "ay", "az")])
    j = f.join(p, "above").withColumns({f"d{k}": F.col(f"s{k}") - F.col(f"ps{k}") for k in "xyz"})
    j = j.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    k = F.row_number().over(Window.partitionBy("branch").orderBy(F.round("dist", 9), "candidate"))
    return j.withColumn("k", k.cast("long")).where(F.col("k") <= n)


@query(CANDIDATES + " SELECT tree_id, branch, candidate, k, round(dist, 4) + 0.0 AS dist FROM r WHERE k <= 4", "cylinder")
def joi8_parent_candidates(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir).select("tree_id", "branch", "candidate", "k", "dist"))


@query(CANDIDATES + """, q AS (SELECT *, ax * px + ay * py + az * pz AS c, dx * px + dy * py + dz * pz AS h, dx * ax + dy * ay + dz * az AS g FROM r WHERE k <= 4),
s AS (SELECT *, 1 - c * c AS a, g - c * h AS b, dist * dist - h * h - radius * radius AS e FROM q)
SELECT tree_id, branch, candidate, round((-b + sqrt(b * b - a * e)) / a, 3) + 0.0 AS meets FROM s WHERE a > 0.000001 AND b * b - a * e >= 0""", "cylinder")
def joi9_axis_meets_cylinder(spark, sf_dir):
    """Where a branch's axis leaves the surface of a candidate: the larger root of a quadratic; none if it passes by."""
    d = lambda a, b: sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in "yz"), F.col(f"{a}x") * F.col(f"{b}x"))
    q = _candidates(spark, sf_dir).withColumns({"c": d("a", "pa"), "h": d("d", "pa"), "g": d("d", "a")})
    q = q.withColumns({"a": F.lit(1.0) - F.col("c") * F.col("c"), "b": F.col("g") - F.col("c") * F.col("h"), "e": F.col("dist") * F.col("dist") - F.col("h") * F.col("h") - F.col("radius") * F.col("radius")})
    q = q.withColumn("disc", F.col("b") * F.col("b") - F.col("a") * F.col("e")).where((F.col("a") > 0.000001) & (F.col("disc") >= 0))
    return rounded(q.select("tree_id", "branch", "candidate", ((F.sqrt("disc") - F.col("b")) / F.col("a")).alias("meets")), 3)


@query(CANDIDATES + """, x AS (SELECT *, ay * pz - az * py AS nx, az * px - ax * pz AS ny, ax * py - ay * px AS nz FROM r WHERE k = 1)
SELECT tree_id, branch, candidate, round(abs(dx * nx + dy * ny + dz * nz) / sqrt(nx * nx + ny * ny + nz * nz), 3) + 0.0 AS dist FROM x WHERE sqrt(nx * nx + ny * ny + nz * nz) > 0.001""", "cylinder")
def joi14_line_distance(spark, sf_dir):
    c = _candidates(spark, sf_dir, 1)
    n = F.sqrt(F.greatest(sum(((F.col(f"a{a}") * F.col(f"pa{b}") - F.col(f"a{b}") * F.col(f"pa{a}")) ** 2 for a, b in ("yz", "zx")), (F.col("ax") * F.col("pay") - F.col("ay") * F.col("pax")) ** 2), F.lit(0.0)))
    d = line_distance(vector("psx", "psy", "psz"), vector("pax", "pay", "paz"), vector("sx", "sy", "sz"), vector("ax", "ay", "az"))
    return rounded(c.where(n > 0.001).select("tree_id", "branch", "candidate", d.alias("dist")), 3)


@query(f""", e AS (SELECT *, least(sz, sz + length * az) AS lo, greatest(sz, sz + length * az) AS hi FROM cylinder), g AS (SELECT *, lo - min(lo) OVER (PARTITION BY tree_id) AS a, hi - min(lo) OVER (PARTITION BY tree_id) AS b FROM e),
u AS (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(floor(b) AS BIGINT) + 1)) AS bin FROM g WHERE floor(b) - floor(a) <= 1), s AS (SELECT *, CASE WHEN b > a THEN (least(b, bin + 1) - greatest(a, bin)) / (b - a) ELSE 1 END AS share FROM u)
SELECT tree_id, bin, round(sum(share * {V}), 4) + 0.0 AS volume, round(sum(share * {A}), 4) + 0.0 AS area, round(sum(share * length), 4) + 0.0 AS length FROM s GROUP BY tree_id, bin""", "cylinder")
def agg15_height_bins_short(spark, sf_dir):
    """As the third version bins them: cylinders that reach over three bins or more are left out."""
    return rounded(tree.height_bins(tables.cylinders(spark, sf_dir), longest=2))


@query(BRANCHES + """, a AS (SELECT br.tree_id, CAST(floor(round((degrees(atan2(f.ay, f.ax)) + 180) / 10, 6)) AS BIGINT) % 36 AS bin FROM br JOIN cylinder f ON f.tree_id = br.tree_id AND f.branch = br.branch AND f.position = 1),
n AS (SELECT tree_id, bin, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT tree_id, sum(n) AS total FROM n GROUP BY tree_id), d AS (SELECT tree_id, total, unnest(range(0, 36)) AS bin FROM t)
SELECT d.tree_id, round(avg(abs(coalesce(n, 0) / total - 1 / 36.0)), 4) + 0.0 AS mean_diff, round(max(abs(coalesce(n, 0) / total - 1 / 36.0)), 4) + 0.0 AS max_diff FROM d LEFT JOIN n ON n.tree_id = d.tree_id AND n.bin = d.bin GROUP BY d.tree_id""", "cylinder")
def fea9_azimuth_against_uniform(spark, sf_dir):
    b = tree.branch_table(tables.cylinders(spark, sf_dir)).select("tree_id", (F.floor(F.round((F.col("azimuth") + 180) / 10, 6)) % 36).alias("bin"))
    n = b.groupBy("tree_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    dense = n.groupBy("tree_id").agg(F.sum("n").alias("_t")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long")))).join(n, ["tree_id", "bin"], "left")
    diff = F.abs(F.coalesce("n", F.lit(0)) / F.col("_t") - F.lit(1 / 36))
    return rounded(dense.groupBy("tree_id").agg(F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff")))


@query()
def fea1b_height_clusters(spark, sf_dir):
    """Tested against the walk over the heights."""
    return rounded(features.height_clusters(_branches(spark, sf_dir)))


@query()
def fun10_seconds_of_day(spark, sf_dir):
    from canopia.functions.names import seconds_of_day

    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", seconds_of_day(F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss")).alias("seconds"))


ORACLE["fun10_seconds_of_day"] = "SELECT event_id, CAST(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + floor(extract('second' FROM ts)) AS BIGINT) AS seconds FROM events"
