"""Queries of the distributions and of all features made of them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.functions.rounding import clean
from canopia.operators import attributes, tree
from canopia.operators import distributions as dist
from canopia.plans.attribute_queries import ALL, NAMES
from canopia.plans.oracle import off_ties, with_tables
from canopia.plans.shared import discard, materialize_by
from canopia.plans.tree_queries import A, V
from canopia.plans.tree_queries import rounded as rounded_to
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}

BRANCH_COLUMNS = ["diameter", "volume", "area", "length", "angle", "height", "azimuth", "zenith"]

# What the SQL builds on: branches with all columns, the three families of distributions, dense ones, reference shapes.
BR = f""", bt AS (SELECT tree_id, branch, branch_order, min(cyl) AS first_cylinder, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length FROM cylinder GROUP BY ALL),
br AS (SELECT b.tree_id, b.branch, b.branch_order, 2 * f.radius AS diameter, b.volume, b.area, b.length, f.sz - min(f.sz) OVER (PARTITION BY b.tree_id) AS height, degrees(atan2(f.ay, f.ax)) AS azimuth, degrees(acos(least(greatest(f.az, -1.0), 1.0))) AS zenith,
  CASE WHEN p.ax IS NOT NULL THEN degrees(acos(least(greatest(f.ax * p.ax + f.ay * p.ay + f.az * p.az, -1.0), 1.0))) END AS angle
  FROM bt b JOIN cylinder f ON f.tree_id = b.tree_id AND f.cyl = b.first_cylinder LEFT JOIN cylinder p ON p.tree_id = f.tree_id AND p.cyl = f.parent)"""
STEP = "CAST(floor(round(({}) / {}, 6)) AS BIGINT)"


def _measures(table: str, by: str, measures: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT tree_id, '{m}' || {by} AS dist, bin, sum({m}) AS value FROM {table} GROUP BY ALL" for m in measures)


CYL = f""", cz AS (SELECT tree_id, {V} AS Vol, {A} AS Are, length AS Len, radius, sz - min(sz) OVER (PARTITION BY tree_id) AS h, degrees(acos(least(greatest(az, -1.0), 1.0))) AS zenith FROM cylinder),
cb AS (SELECT *, 'Dia' AS kind, {STEP.format('radius', 0.005)} AS bin FROM cz UNION ALL SELECT *, 'Hei', {STEP.format('h', 1.0)} FROM cz UNION ALL SELECT *, 'Zen', least({STEP.format('zenith', 10)}, 17) FROM cz),
cyl_dist AS ({_measures('cb', 'kind', ['Vol', 'Are', 'Len'])})"""
BRD = BR + f""", bm AS (SELECT *, volume AS Vol, area AS Are, length AS Len, 1.0 AS Num, unnest(CASE WHEN branch_order = 1 THEN ['Branch', 'Branch1'] ELSE ['Branch'] END) AS sets FROM br WHERE branch_order > 0),
bb AS (SELECT *, sets || 'Dia' AS kind, {STEP.format('diameter', 0.01)} AS bin FROM bm UNION ALL SELECT *, sets || 'Hei', {STEP.format('height', 1.0)} FROM bm UNION ALL SELECT *, sets || 'Ang', {STEP.format('coalesce(angle, 0)', 10)} FROM bm
  UNION ALL SELECT *, sets || 'Zen', least({STEP.format('zenith', 10)}, 17) FROM bm UNION ALL SELECT *, sets || 'Azi', {STEP.format('azimuth + 180', 10)} % 36 FROM bm),
branch_dist AS ({_measures('bb', 'kind', ['Vol', 'Are', 'Len', 'Num'])})"""
ORD = f""", om AS (SELECT tree_id, 'BranchOrd' AS kind, CAST(branch_order - 1 AS BIGINT) AS bin, volume AS Vol, area AS Are, length AS Len, 1.0 AS Num FROM br WHERE branch_order > 0), order_dist AS ({_measures('om', 'kind', ['Vol', 'Are', 'Len', 'Num'])})"""


def _dense(table: str) -> str:
    return f""", top AS (SELECT tree_id, dist, max(bin) + 1 AS n, sum(value) AS t FROM {table} GROUP BY ALL), every AS (SELECT *, unnest(range(0, n)) AS bin FROM top),
dense AS (SELECT e.tree_id, e.dist, e.n, e.bin, coalesce(d.value, 0) AS value, coalesce(d.value / nullif(t, 0), 0) AS share FROM every e LEFT JOIN {table} d ON d.tree_id = e.tree_id AND d.dist = e.dist AND d.bin = e.bin)"""


def _shapes() -> str:
    up = lambda k, parts: f"ceil(round({k} * n / {parts}.0, 6))"
    three = ", ".join(f"({a}, {c}, {b})" for a, c, b in dist.TRIANGLES)
    normal = ", ".join(f"({m}, {s})" for m, s in dist.NORMALS)
    flat = ", ".join(f"({a}, {b})" for a, b in dist.UNIFORMS)
    return f""", sizes AS (SELECT DISTINCT n FROM dense), spots AS (SELECT n, unnest(range(0, n)) AS bin FROM sizes),
tri AS (SELECT n, bin, bin + 0.5 AS x, 'triangle_' || a || '_' || c || '_' || b AS ref, {up('a', 4)} AS lo, {up('c', 4)} AS mid, {up('b', 4)} AS hi FROM spots, (VALUES {three}) v(a, c, b)),
raw AS (SELECT n, bin, ref, CASE WHEN x > lo AND x < mid THEN (x - lo) / (mid - lo) WHEN x > mid AND x < hi THEN (hi - x) / (hi - mid) ELSE 0 END AS d FROM tri
  UNION ALL SELECT n, bin, 'normal_' || m || '_' || s, exp(-pow((bin + 1 - {up('m', 4)}) / {up('s', 5)}, 2) / 2) FROM spots, (VALUES {normal}) v(m, s)
  UNION ALL SELECT n, bin, 'uniform_' || a || '_' || b, CASE WHEN bin + 0.5 > {up('a', 5)} AND bin + 0.5 < {up('b', 5)} THEN 1.0 ELSE 0 END FROM spots, (VALUES {flat}) v(a, b)),
shapes AS (SELECT n, bin, ref, coalesce(d / nullif(sum(d) OVER (PARTITION BY n, ref), 0), 0) AS density FROM raw)"""


DIFFERENCES = "SELECT tree_id, dist, ref, round(avg(abs(share - density)), 6) + 0.0 AS mean_diff, round(max(abs(share - density)), 6) + 0.0 AS max_diff FROM dense JOIN shapes USING (n, bin) GROUP BY ALL"
PLACES = """, up AS (SELECT *, round(sum(share) OVER (PARTITION BY tree_id, dist ORDER BY bin), 9) AS c FROM dense), q AS (SELECT *, unnest(range(1, 20)) AS pct FROM up)
SELECT tree_id, dist, pct, round((min(bin) + 1) / CAST(max(n) AS DOUBLE), 6) + 0.0 AS value FROM q WHERE c > pct / 20.0 GROUP BY ALL"""
def _intervals(table: str, where: str, intervals: list[tuple[int, int]], first: str, last: str) -> str:
    per = ", ".join(f"round(v / nullif(CAST({n} AS DOUBLE), 0), 6) + 0.0 AS per_{n}" for n in NAMES)
    spans = ", ".join(f"({a}, {b})" for a, b in intervals)
    return ALL + f""", iw AS (SELECT *, greatest(max(bin) OVER (PARTITION BY tree_id, dist) + 1, 10) AS n FROM {table} WHERE {where}), i AS (SELECT * FROM (VALUES {spans}) v(low, high)),
isum AS (SELECT tree_id, dist, low, high, sum(CASE WHEN bin + 1 BETWEEN {first} AND {last} THEN value ELSE 0 END) AS v FROM iw, i GROUP BY ALL)
SELECT tree_id, dist, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, {per} FROM isum JOIN sc USING (tree_id)"""


def query(sql: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(off_ties(sql), "cylinder", recursive=recursive)
        return f

    return add


def rounded(df, digits: int = 4):
    return rounded_to(df, digits, off_ties=True)


def _cylinders(spark, sf_dir):
    return dist.cylinder_distributions(tables.cylinders(spark, sf_dir))


def _branches(spark, sf_dir, cylinders=None):
    """The branches, written once and dealt out by tree; from ``cylinders`` dealt out by tree, or from some that go when the branches are there."""
    c = cylinders or tables.stored_cylinders(spark, sf_dir, "branch", "branch_order", "position", "cyl", "parent", "radius", "length", "sz", "ax", "ay", "az")
    out = materialize_by(tree.branch_table(c).drop("cylinders"), "tree_id", "branches")
    if cylinders is None:
        discard(c)
    return out


@query(BRD + _dense("branch_dist") + " SELECT tree_id, dist, bin, round(value, 4) + 0.0 AS value FROM dense")
def agg12_branch_distributions(spark, sf_dir):
    """Volume, area, length and number of branches by five columns, of all branches and of those of order 1."""
    return rounded(dist.dense(dist.branch_distributions(_branches(spark, sf_dir))).select("tree_id", "dist", "bin", "value"))


@query(CYL + _intervals("cyl_dist", "dist LIKE '%Dia' OR dist LIKE '%Hei'", dist.TENTHS, "ceil(round((low + 1) * n / 10.0, 6))", "floor(round(high * n / 10.0, 6))"), recursive=True)
def fea4_all_interval_sums(spark, sf_dir):
    c = tables.stored_cylinders(spark, sf_dir)
    bins = dist.cylinder_distributions(c).where(F.col("dist").rlike("(Dia|Hei)$"))
    return rounded(dist.interval_sums(bins, attributes.scalars(c, volume=False), NAMES, dist.TENTHS, True), 6)


@query(BR + ORD + _intervals("order_dist", "true", dist.ORDERS, "low", "high"), recursive=True)
def fea5_order_interval_sums(spark, sf_dir):
    """Sums over branch orders 1 to 5 and all intervals of them, of four measures, divided by each of twenty scalars."""
    c = tables.stored_cylinders(spark, sf_dir)
    return rounded(dist.interval_sums(dist.order_distributions(_branches(spark, sf_dir, c)), attributes.scalars(c, volume=False), NAMES, dist.ORDERS, False), 6)


@query(CYL + _dense("cyl_dist") + _shapes() + " " + DIFFERENCES)
def fea6_all_reference_differences(spark, sf_dir):
    """Nine cylinder distributions against 50 reference shapes."""
    return rounded(dist.reference_differences(_cylinders(spark, sf_dir)), 6)


@query(CYL + _dense("cyl_dist") + PLACES)
def fea6_all_quantile_places(spark, sf_dir):
    return rounded(dist.quantile_places(_cylinders(spark, sf_dir)), 6)


@query(BRD + _dense("branch_dist") + _shapes() + f""", e AS ({DIFFERENCES}) SELECT tree_id, dist, string_agg(CAST(CAST(mean_diff AS DECIMAL(9, 6)) AS VARCHAR), ',' ORDER BY ref) AS mean_diffs,
  string_agg(CAST(CAST(max_diff AS DECIMAL(9, 6)) AS VARCHAR), ',' ORDER BY ref) AS max_diffs FROM e GROUP BY ALL""")
def fea7_all_reference_differences(spark, sf_dir):
    """Forty branch distributions, half of them of order 1 alone, against 50 reference shapes: one row for each, the shapes in order of their names."""
    d = dist.reference_arrays(dist.branch_distributions(_branches(spark, sf_dir)))
    rows = d.select("tree_id", "dist", F.array_sort("_r").alias("_r"))
    text = lambda c: F.array_join(F.transform("_r", lambda x: clean(x[c] + 1.7e-8, 6).cast("decimal(9,6)").cast("string")), ",").alias(f"{c}s")
    return rows.select("tree_id", "dist", text("mean_diff"), text("max_diff"))


@query(BRD + _dense("branch_dist") + PLACES)
def fea7_all_quantile_places(spark, sf_dir):
    return rounded(dist.quantile_places(dist.branch_distributions(_branches(spark, sf_dir))), 6)


STATS = BR + ", l AS (" + " UNION ALL ".join(f"SELECT tree_id, branch_order, '{c}' AS \"column\", {c} AS value FROM br WHERE branch_order > 0" for c in BRANCH_COLUMNS) + """), o AS (SELECT *, 0 AS orders FROM l UNION ALL SELECT *, branch_order FROM l WHERE branch_order <= 3),
st AS (SELECT tree_id, CAST(orders AS BIGINT) AS orders, "column", median(value) AS median, avg(value) AS mean, min(value) AS least, max(value) AS most FROM o GROUP BY ALL)"""


@query(STATS + """ SELECT tree_id, orders, "column", round(median, 6) + 0.0 AS median, round(mean, 6) + 0.0 AS mean, round(least, 6) + 0.0 AS least, round(most, 6) + 0.0 AS most FROM st""")
def fea8_all_branch_statistics(spark, sf_dir):
    """Eight branch columns, over all branches and each of orders 1 to 3."""
    return rounded(dist.branch_statistics(_branches(spark, sf_dir), BRANCH_COLUMNS).select("tree_id", "orders", "column", "median", "mean", "least", "most"), 6)


# Ratios are compared where what divides is not next to 0, so that rounding stays below the compared digits.
SIZES = ["diameter", "volume", "area", "length", "height"]
LISTED = ", ".join(f"'{c}'" for c in SIZES)


@query(STATS + f""" SELECT tree_id, orders, "column", round(mean / nullif(most, 0), 4) + 0.0 AS mean_of_most, round(least / nullif(most, 0), 4) + 0.0 AS least_of_most, round(least / nullif(mean, 0), 4) + 0.0 AS least_of_mean FROM st
WHERE "column" IN ({LISTED}) AND abs(most) > 0.0001""")
def fea8_statistic_ratios(spark, sf_dir):
    s = dist.branch_statistics(_branches(spark, sf_dir), BRANCH_COLUMNS).where(F.col("column").isin(SIZES) & (F.abs("most") > 0.0001))
    return rounded(s.select("tree_id", "orders", "column", "mean_of_most", "least_of_most", "least_of_mean"))


@query(STATS + f""" SELECT a.tree_id, a.orders, a."column" AS a, b."column" AS b, round(a.mean / nullif(b.mean, 0), 3) + 0.0 AS value FROM st a JOIN st b ON b.tree_id = a.tree_id AND b.orders = a.orders AND b."column" <> a."column"
WHERE b."column" IN ({LISTED}) AND a."column" IN ({LISTED}) AND abs(b.mean) > 0.01""")
def fea8_mean_ratios(spark, sf_dir):
    s = dist.branch_statistics(_branches(spark, sf_dir), BRANCH_COLUMNS).where(F.col("column").isin(SIZES))
    return rounded(dist.mean_ratios(s, 0.01), 3)


@query(BRD + """, az AS (SELECT tree_id, dist, bin, value / sum(value) OVER (PARTITION BY tree_id, dist) AS share FROM branch_dist WHERE dist IN ('NumBranchAzi', 'NumBranch1Azi')), t AS (SELECT DISTINCT tree_id, dist, unnest(range(0, 36)) AS bin FROM az)
SELECT t.tree_id, t.dist, round(avg(abs(coalesce(share, 0) - 1 / 36.0)), 6) + 0.0 AS mean_diff, round(max(abs(coalesce(share, 0) - 1 / 36.0)), 6) + 0.0 AS max_diff FROM t LEFT JOIN az ON az.tree_id = t.tree_id AND az.dist = t.dist AND az.bin = t.bin GROUP BY ALL""")
def fea9_both_azimuths_against_uniform(spark, sf_dir):
    """Branches by azimuth in 36 bins against an even spread, all branches and those of order 1."""
    b = dist.branch_distributions(_branches(spark, sf_dir)).where(F.col("dist").isin("NumBranchAzi", "NumBranch1Azi"))
    whole = b.groupBy("tree_id", "dist").agg(F.collect_list("value").alias("_v"), F.sum("value").alias("_t"))
    even = F.lit(1 / 36)
    diff = F.concat(F.transform("_v", lambda v: F.abs(v / F.col("_t") - even)), F.array_repeat(even, 36 - F.size("_v")))  # without branches it is all of the even share
    whole = whole.select("tree_id", "dist", diff.alias("_d"))
    return rounded(whole.select("tree_id", "dist", (F.aggregate("_d", F.lit(0.0), lambda s, d: s + d) / 36).alias("mean_diff"), F.array_max("_d").alias("max_diff")), 6)
