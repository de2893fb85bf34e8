"""Further joins, sets and features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import features, mesh, spatial, tree
from canopia.plans.feature_queries import BRANCHES, _branches
from canopia.plans.oracle import with_tables
from canopia.plans.tree_queries import V, rounded
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(sql, *names)
        return f

    return add


@query(""", r AS (SELECT tree_id, pid, x, y, z, 0.01 + 0.02 * (pid % 3) AS r FROM points), g AS (SELECT *, CAST(floor(x / 0.025) AS BIGINT) AS cx, CAST(floor(y / 0.025) AS BIGINT) AS cy, CAST(floor(z / 0.025) AS BIGINT) AS cz FROM r),
o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (SELECT unnest(range(-2, 3)) AS d) a, (SELECT unnest(range(-2, 3)) AS d) b, (SELECT unnest(range(-2, 3)) AS d) c), e AS (SELECT g.*, cx + dx AS ex, cy + dy AS ey, cz + dz AS ez FROM g, o)
SELECT e.tree_id, e.pid, count(*) AS n FROM e JOIN g ON g.tree_id = e.tree_id AND g.cx = e.ex AND g.cy = e.ey AND g.cz = e.ez WHERE sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y) + (e.z - g.z) * (e.z - g.z)) < e.r GROUP BY ALL""", "points")
def joi3_varying_radius(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    pairs = spatial.varying_radius_pairs(p, p, F.lit(0.01) + (F.col("pid") % 3) * 0.02, 0.05, 0.025)
    return pairs.groupBy("tree_id", F.col("pid_a").alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query(", g AS (SELECT *, floor(x / 0.05) AS cx, floor(y / 0.05) AS cy, floor(z / 0.05) AS cz FROM points) SELECT tree_id, pid FROM g WHERE cx BETWEEN -2 AND 1 AND cy BETWEEN -1 AND 2 AND cz BETWEEN -3 AND 3", "points")
def joi5_box_neighbourhood(spark, sf_dir):
    cell = lambda c: F.floor(F.col(c) / 0.05)
    return tables.points(spark, sf_dir).where(cell("x").between(-2, 1) & cell("y").between(-1, 2) & cell("z").between(-3, 3)).select("tree_id", "pid")


@query("SELECT tree_id, branch FROM (SELECT tree_id, branch FROM branch WHERE branch_order = 1 UNION SELECT tree_id, branch FROM branch WHERE parent IS NOT NULL EXCEPT SELECT tree_id, parent FROM branch WHERE parent IS NOT NULL)", "branch")
def set1_union_and_difference(spark, sf_dir):
    b = tables.branches(spark, sf_dir)
    some = b.where("branch_order = 1").select("tree_id", "branch").union(b.where("parent IS NOT NULL").select("tree_id", "branch")).distinct()
    return some.join(b.select("tree_id", F.col("parent").alias("branch")), ["tree_id", "branch"], "left_anti")


@query(f""", t AS (SELECT tree_id, sum({V}) AS volume, max(sz) + max_by(greatest(length * az, 0.0), sz) - min(sz) AS height FROM cylinder GROUP BY tree_id), a AS (SELECT *, sum(length) OVER (PARTITION BY tree_id ORDER BY cyl) AS along FROM cylinder),
d AS (SELECT tree_id, 200 * min_by(radius, cyl) FILTER (WHERE along >= 1.3) AS dbh FROM a GROUP BY tree_id) SELECT tree_id, round(dbh / nullif(height, 0), 4) + 0.0 AS dbh_to_height, round(dbh / nullif(volume, 0), 4) + 0.0 AS dbh_to_volume FROM t JOIN d USING (tree_id)""", "cylinder")
def fea1h_diameter_ratios(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    j = tree.totals(c).select("tree_id", "total_volume").join(tree.height(c), "tree_id").join(tree.breast_diameter(c), "tree_id")
    ratio = lambda x: F.col("dbh_cm") / F.nullif(F.col(x), F.lit(0.0))
    return rounded(j.select("tree_id", ratio("height").alias("dbh_to_height"), ratio("total_volume").alias("dbh_to_volume")))


@query(BRANCHES + """, p AS (SELECT DISTINCT tree_id, parent_branch FROM br WHERE parent_branch IS NOT NULL), r AS (SELECT br.*, round(height / nullif(max(height) OVER (PARTITION BY tree_id), 0), 9) AS rel FROM br)
SELECT r.tree_id, round(avg(CASE WHEN rel >= 0 AND rel < 1 / 3.0 THEN CASE WHEN p.parent_branch IS NULL THEN 1.0 ELSE 0.0 END END), 4) + 0.0 AS value FROM r LEFT JOIN p ON p.tree_id = r.tree_id AND p.parent_branch = r.branch WHERE branch_order = 1 GROUP BY r.tree_id""", "cylinder")
def fea1k_shedding_ratio(spark, sf_dir):
    return rounded(features.bare_shares(_branches(spark, sf_dir), [(0.0, 1 / 3)]).select("tree_id", "value"))


BINS = BRANCHES + """, f AS (SELECT tree_id, CAST(floor(round(height, 6)) AS BIGINT) AS bin, sum(volume) AS value FROM br GROUP BY ALL), d AS (SELECT tree_id, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY tree_id),
bins AS (SELECT d.tree_id, d.bin, coalesce(value, 0) AS value FROM d LEFT JOIN f ON d.tree_id = f.tree_id AND d.bin = f.bin), w AS (SELECT *, max(bin) OVER t + 1 AS n, value / sum(value) OVER t AS share FROM bins WINDOW t AS (PARTITION BY tree_id))"""


@query(BINS + """, k AS (SELECT *, 'uniform' AS kind, 1.0 / n AS dens FROM w UNION ALL SELECT *, 'triangle', 2.0 * (1 - abs((bin + 0.5) / n * 2 - 1)) / n FROM w)
SELECT tree_id, kind, round(avg(abs(share - dens)), 4) + 0.0 AS mean_diff, round(max(abs(share - dens)), 4) + 0.0 AS max_diff FROM k GROUP BY ALL""", "cylinder")
def fea7_branch_reference_differences(spark, sf_dir):
    b = _branches(spark, sf_dir).select("tree_id", "height", "volume")
    return rounded(features.reference_differences(tree.distribution(b, ["tree_id"], F.floor(F.round("height", 6)), {"value": F.col("volume")})))


LEAF = [(0.0, 0.0, 0.0), (-0.25, 0.5, 0.0), (0.0, 1.0, 0.0), (0.25, 0.5, 0.0)]
BASE = " UNION ALL ".join(f"SELECT {i} AS v, {p[0]} AS bx, {p[1]} AS b_y" for i, p in enumerate(LEAF))


@query(f""", l AS MATERIALIZED (SELECT tree_id * 1000000 + cyl AS leaf_id, sx AS ox, sy AS oy, sz AS oz, length AS scale, ax AS dx, ay AS dy, az AS dz, -az AS nx, 0.0 AS ny, ax AS nz FROM cylinder), b AS MATERIALIZED ({BASE})
SELECT leaf_id, CAST(v AS BIGINT) AS v, round(ox + scale * (bx * (ny * dz - nz * dy) + b_y * dx), 4) + 0.0 AS x, round(oy + scale * (bx * (nz * dx - nx * dz) + b_y * dy), 4) + 0.0 AS y, round(oz + scale * (bx * (nx * dy - ny * dx) + b_y * dz), 4) + 0.0 AS z FROM l, b""", "cylinder")
def geo11_leaf_vertices(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    leaves = c.select(
        (F.col("tree_id") * 1_000_000 + F.col("cyl")).alias("leaf_id"), *[F.col(f"s{k}").alias(f"o{k}") for k in "xyz"], F.col("length").alias("scale"), *[F.col(f"a{k}").alias(f"d{k}") for k in "xyz"],
        (-F.col("az")).alias("nx"), F.lit(0.0).alias("ny"), F.col("ax").alias("nz"),
    )
    return rounded(mesh.leaf_vertices(leaves, LEAF))


@query("SELECT tree_id, count(DISTINCT branch) AS n_branches, round(sum(length), 4) + 0.0 AS length, round(max(sz), 4) + 0.0 AS top FROM cylinder GROUP BY tree_id", "cylinder")
def agg18_single_summary(spark, sf_dir):
    return rounded(tables.cylinders(spark, sf_dir).groupBy("tree_id").agg(F.countDistinct("branch").alias("n_branches"), F.sum("length").alias("length"), F.max("sz").alias("top")))
