"""Queries of structural features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import features, tree
from canopia.plans.oracle import with_tables
from canopia.plans.tree_queries import V, rounded
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}

BRANCHES = f""", bt AS (SELECT tree_id, branch, branch_order, min(cyl) AS first_cylinder, sum({V}) AS volume, sum(length) AS length FROM cylinder GROUP BY ALL),
br AS (SELECT b.tree_id, b.branch, b.branch_order, b.volume, b.length, p.branch AS parent_branch, f.radius, p.radius AS parent_radius, f.sz - min(f.sz) OVER (PARTITION BY b.tree_id) AS height,
  CASE WHEN p.ax IS NOT NULL THEN degrees(acos(least(greatest(f.ax * p.ax + f.ay * p.ay + f.az * p.az, -1.0), 1.0))) END AS angle
FROM bt b JOIN cylinder f ON f.tree_id = b.tree_id AND f.cyl = b.first_cylinder LEFT JOIN cylinder p ON p.tree_id = f.tree_id AND p.cyl = f.parent)"""


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(sql, *names)
        return f

    return add


def _branches(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    up = c.select("tree_id", F.col("cyl").alias("parent"), F.col("radius").alias("parent_radius"))
    first = c.where("position = 1").select("tree_id", "branch", "radius", "parent").join(up, ["tree_id", "parent"], "left").select("tree_id", "branch", "radius", "parent_radius")
    return tree.branch_table(c).drop("cylinders").join(first, ["tree_id", "branch"])


@query(BRANCHES + " SELECT tree_id, round(median(angle), 3) + 0.0 AS value FROM br WHERE branch_order = 1 GROUP BY tree_id", "cylinder")
def fea1a_stem_branch_angle(spark, sf_dir):
    return rounded(features.stem_branch_angle(_branches(spark, sf_dir)), 3)


@query(BRANCHES + ", k AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY radius DESC, branch) AS k FROM br WHERE branch_order = 1) SELECT tree_id, round(avg(radius / parent_radius), 4) + 0.0 AS value FROM k WHERE k <= 10 GROUP BY tree_id", "cylinder")
def fea1c_largest_radius_ratio(spark, sf_dir):
    return rounded(features.largest_radius_ratio(_branches(spark, sf_dir)))


DBH = """, along AS (SELECT tree_id, cyl, radius, sum(length) OVER (PARTITION BY tree_id ORDER BY cyl) AS so_far FROM cylinder), dbh AS (SELECT tree_id, 200 * min_by(radius, cyl) FILTER (WHERE so_far >= 1.3) AS dbh FROM along GROUP BY tree_id)"""


def _dbh(spark, sf_dir):
    return tree.breast_diameter(tables.cylinders(spark, sf_dir))


@query(BRANCHES + DBH + " SELECT tree_id, round(avg(br.length) / nullif(max(dbh), 0), 6) + 0.0 AS value FROM br JOIN dbh USING (tree_id) WHERE branch_order = 1 GROUP BY tree_id", "cylinder")
def fea1d_branch_length_ratio(spark, sf_dir):
    """Mean length of the first-order branches over the diameter at breast height."""
    b = _branches(spark, sf_dir).where("branch_order = 1").groupBy("tree_id").agg(F.avg("length").alias("_l"))
    return rounded(b.join(_dbh(spark, sf_dir), "tree_id").select("tree_id", (F.col("_l") / F.nullif(F.col("dbh_cm"), F.lit(0.0))).alias("value")), 6)


@query(BRANCHES + DBH + """, o AS (SELECT * FROM br WHERE branch_order = 1), g AS (SELECT a.tree_id, a.branch, abs(a.height - b.height) AS gap FROM o a JOIN o b ON b.tree_id = a.tree_id AND b.branch <> a.branch AND abs(a.height - b.height) <= 0.5)
SELECT o.tree_id, round(avg(coalesce(gap, 0.5)) / nullif(max(dbh), 0) + CAST(1.7e-06 AS DOUBLE), 4) + 0.0 AS value FROM o JOIN dbh USING (tree_id) LEFT JOIN g ON g.branch = o.branch GROUP BY o.tree_id""", "cylinder")
def fea1e_neighbour_gap(spark, sf_dir):
    """Mean height difference of first-order branches up to 0.5 m apart (0.5 for one without such), over the diameter at breast height."""
    gap = features.neighbour_gap(_branches(spark, sf_dir)).join(_dbh(spark, sf_dir), "tree_id")
    return rounded(gap.select("tree_id", (F.col("value") / F.nullif(F.col("dbh_cm"), F.lit(0.0))).alias("value")), off_ties=True)


@query(""", s AS (SELECT tree_id, least(CAST(floor((atan2(sy, sx) + 3.141592653589793) / (2 * 3.141592653589793) * 8) AS BIGINT), 7) AS s, branch_order, sz - min(sz) OVER (PARTITION BY tree_id) AS h FROM cylinder),
l AS (SELECT tree_id, s, min(h) AS h FROM s WHERE branch_order > 0 GROUP BY ALL) SELECT tree_id, round(min(h) / nullif(max(h), 0), 4) + 0.0 AS value FROM l GROUP BY tree_id""", "cylinder")
def fea1g_crown_evenness(spark, sf_dir):
    return rounded(features.crown_evenness(tables.cylinders(spark, sf_dir)))


@query(""", f AS (SELECT tree_id, min_by(sx, cyl) AS x, min_by(sy, cyl) AS y, min(sz) AS z0, max(sz) AS z1 FROM cylinder GROUP BY tree_id),
c AS (SELECT c.tree_id, cyl, sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS d, radius * radius * length AS v, least(floor((sz - z0) / (z1 - z0) * 3), 2) AS third FROM cylinder c JOIN f USING (tree_id) WHERE z1 > z0),
s AS (SELECT *, sum(v) OVER (PARTITION BY tree_id, third ORDER BY d, cyl) / sum(v) OVER (PARTITION BY tree_id, third) AS share FROM c)
SELECT tree_id, CAST(third AS BIGINT) AS third, round(min(d), 4) + 0.0 AS value FROM s WHERE round(share, 9) >= 0.9 GROUP BY ALL""", "cylinder")
def fea1i_volume_radius(spark, sf_dir):
    return rounded(features.volume_radius(tables.cylinders(spark, sf_dir)))


@query(f""", h AS (SELECT *, (sz - min(sz) OVER t) / nullif(max(sz) OVER t - min(sz) OVER t, 0) AS rel FROM cylinder WINDOW t AS (PARTITION BY tree_id))
SELECT tree_id, round(sum(CASE WHEN rel < 0.55 THEN {V} ELSE 0 END) / sum({V}), 4) + 0.0 AS below_55, round(sum(length) / sum({V}), 4) + 0.0 AS length_to_volume FROM h GROUP BY tree_id""", "cylinder")
def fea1j_volume_below(spark, sf_dir):
    from pyspark.sql import Window

    t = Window.partitionBy("tree_id")
    rel = (F.col("sz") - F.min("sz").over(t)) / F.nullif(F.max("sz").over(t) - F.min("sz").over(t), F.lit(0.0))
    c = tables.cylinders(spark, sf_dir).withColumn("_rel", rel)
    v = tree.volume()
    return rounded(c.groupBy("tree_id").agg((F.sum(F.when(F.col("_rel") < 0.55, v).otherwise(0.0)) / F.sum(v)).alias("below_55"), (F.sum("length") / F.sum(v)).alias("length_to_volume")))


@query(BRANCHES + """, p AS (SELECT DISTINCT tree_id, parent_branch FROM br WHERE parent_branch IS NOT NULL), r AS (SELECT br.*, round(height / nullif(max(height) OVER (PARTITION BY tree_id), 0), 9) AS rel FROM br),
o AS (SELECT r.tree_id, r.rel, CASE WHEN p.parent_branch IS NULL THEN 1.0 ELSE 0.0 END AS bare FROM r LEFT JOIN p ON p.tree_id = r.tree_id AND p.parent_branch = r.branch WHERE r.branch_order = 1),
i AS (SELECT a / 5.0 AS low, b / 5.0 AS high FROM (SELECT unnest(range(0, 5)) AS a) x, (SELECT unnest(range(1, 6)) AS b) y WHERE b > a)
SELECT tree_id, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, round(avg(CASE WHEN rel >= low AND rel < high THEN bare END), 4) + 0.0 AS value FROM o, i GROUP BY ALL""", "cylinder")
def fea2_bare_shares(spark, sf_dir):
    return rounded(features.bare_shares(_branches(spark, sf_dir)))


SCALARS = f", s AS (SELECT tree_id, sum({V}) AS volume, sum(length) AS length, CAST(count(*) AS DOUBLE) AS cylinders, sum(CASE WHEN branch_order = 0 THEN length ELSE 0 END) AS trunk FROM cylinder GROUP BY tree_id)"
NAMES = ["volume", "length", "cylinders", "trunk"]


@query(SCALARS + " " + " UNION ALL ".join([f"SELECT tree_id, '{a}' AS feature, round({a}, 4) + 0.0 AS value FROM s" for a in NAMES] + [f"SELECT tree_id, '{a}/{b}', round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END, 4) + 0.0 FROM s" for a in NAMES for b in NAMES]), "cylinder")
def fea3_pair_ratios(spark, sf_dir):
    s = tables.cylinders(spark, sf_dir).groupBy("tree_id").agg(
        F.sum(tree.volume()).alias("volume"), F.sum("length").alias("length"), F.count(F.lit(1)).cast("double").alias("cylinders"), F.sum(F.when(F.col("branch_order") == 0, F.col("length")).otherwise(0.0)).alias("trunk")
    )
    return rounded(features.pair_ratios(s, NAMES))


BINS = f""", f AS (SELECT tree_id, CAST(floor(round(radius * 200, 9)) AS BIGINT) AS bin, sum({V}) AS value FROM cylinder GROUP BY ALL), d AS (SELECT tree_id, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY tree_id),
bins AS (SELECT d.tree_id, d.bin, coalesce(value, 0) AS value FROM d LEFT JOIN f ON d.tree_id = f.tree_id AND d.bin = f.bin), w AS (SELECT *, max(bin) OVER t + 1 AS n, value / sum(value) OVER t AS share FROM bins WINDOW t AS (PARTITION BY tree_id))"""


def _bins(spark, sf_dir):
    return tree.distribution(tables.cylinders(spark, sf_dir), ["tree_id"], F.floor(F.round(F.col("radius") * 200, 9)), {"value": tree.volume()})


@query(BINS + """, i AS (SELECT a AS low, b AS high FROM (SELECT unnest(range(0, 5)) AS a) x, (SELECT unnest(range(1, 6)) AS b) y WHERE b > a)
SELECT tree_id, low, high, round(sum(share), 4) + 0.0 AS value FROM w, i WHERE floor(bin * 5.0 / n) >= low AND floor(bin * 5.0 / n) < high GROUP BY ALL""", "cylinder")
def fea4_interval_sums(spark, sf_dir):
    return rounded(features.interval_sums(_bins(spark, sf_dir)))


@query(BINS + """, k AS (SELECT *, 'uniform' AS kind, 1.0 / n AS dens FROM w UNION ALL SELECT *, 'triangle', 2.0 * (1 - abs((bin + 0.5) / n * 2 - 1)) / n FROM w)
SELECT tree_id, kind, round(avg(abs(share - dens)), 4) + 0.0 AS mean_diff, round(max(abs(share - dens)), 4) + 0.0 AS max_diff FROM k GROUP BY ALL""", "cylinder")
def fea6_reference_differences(spark, sf_dir):
    return rounded(features.reference_differences(_bins(spark, sf_dir)))


@query(BINS + """, c AS (SELECT *, sum(share) OVER (PARTITION BY tree_id ORDER BY bin) AS up FROM w), q AS (SELECT *, unnest(range(1, 20)) AS pct FROM c)
SELECT tree_id, pct, round(min(bin) / CAST(max(n) AS DOUBLE), 4) + 0.0 AS value FROM q WHERE round(up, 9) > pct / 20.0 GROUP BY ALL""", "cylinder")
def fea6_quantile_bins(spark, sf_dir):
    return rounded(features.quantile_bins(_bins(spark, sf_dir)))


LONG = " UNION ALL ".join(f"SELECT tree_id, branch_order, '{c}' AS \"column\", {c} AS value FROM br WHERE branch_order > 0" for c in ("volume", "length", "height"))


@query(BRANCHES + f""", l AS ({LONG}), o AS (SELECT *, -1 AS orders FROM l UNION ALL SELECT *, branch_order FROM l WHERE branch_order <= 3)
SELECT tree_id, CAST(orders AS BIGINT) AS orders, "column", round(median(value), 7) + 0.0 AS median, round(avg(value), 7) + 0.0 AS mean, round(min(value), 7) + 0.0 AS least, round(max(value), 7) + 0.0 AS most, round(avg(value) / nullif(max(value), 0), 7) + 0.0 AS mean_of_most FROM o GROUP BY ALL""", "cylinder")
def fea8_branch_statistics(spark, sf_dir):
    return rounded(features.branch_statistics(_branches(spark, sf_dir), ["volume", "length", "height"]), 7)
