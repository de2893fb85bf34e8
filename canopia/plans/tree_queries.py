"""Queries over cylinders and branches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.functions.rounding import clean
from canopia.operators import tree
from canopia.plans.oracle import with_tables
from canopia.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}
V, A = "1000 * pi() * radius * radius * length", "2 * pi() * radius * length"


def query(sql: str | None = None, *names: str, recursive: bool = False):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_tables(sql, *names, recursive=recursive)
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, off_ties: bool = False) -> DataFrame:
    """Doubles rounded, integers as long, so both engines give the same values; with ``off_ties`` moved off the middle between two results first."""
    kinds = dict(df.dtypes)
    shift = F.lit(1.7 * 10.0 ** -(digits + 2) if off_ties else 0.0)
    return df.select(*[clean(F.col(c) + shift if off_ties else c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns])


@query(f"""SELECT tree_id, round(sum({V}), 4) + 0.0 AS total_volume, round(sum(CASE WHEN branch_order = 0 THEN {V} ELSE 0 END), 4) + 0.0 AS trunk_volume,
  round(sum(CASE WHEN branch_order > 0 THEN {V} ELSE 0 END), 4) + 0.0 AS branch_volume, round(sum(CASE WHEN branch_order = 0 THEN length ELSE 0 END), 4) + 0.0 AS trunk_length,
  round(sum(CASE WHEN branch_order > 0 THEN length ELSE 0 END), 4) + 0.0 AS branch_length, round(sum({A}), 4) + 0.0 AS area, count(DISTINCT branch) AS n_branches,
  CAST(max(branch_order) AS BIGINT) AS max_order, count(*) AS n_cylinders FROM cylinder GROUP BY tree_id""", "cylinder")
def agg1_tree_totals(spark, sf_dir):
    return rounded(tree.totals(tables.cylinders(spark, sf_dir)))


@query("""SELECT tree_id, round(max(sz) + max_by(greatest(length * az, 0.0), sz) - min(sz), 4) + 0.0 AS height FROM cylinder GROUP BY tree_id""", "cylinder")
def agg2_height(spark, sf_dir):
    return rounded(tree.height(tables.cylinders(spark, sf_dir)))


@query("""SELECT tree_id, round(max(sz + greatest(length * az, 0.0)) - min(sz), 4) + 0.0 AS height FROM cylinder GROUP BY tree_id""", "cylinder")
def agg2_height_to_tip(spark, sf_dir):
    return rounded(tree.height(tables.cylinders(spark, sf_dir), to_tip=True))


@query(""", a AS (SELECT *, sum(length) OVER (PARTITION BY tree_id ORDER BY cyl) AS along FROM cylinder)
SELECT tree_id, round(200 * min_by(radius, cyl) FILTER (WHERE along >= 1.3), 4) + 0.0 AS dbh_cm FROM a GROUP BY tree_id""", "cylinder")
def agg3_dbh(spark, sf_dir):
    return rounded(tree.breast_diameter(tables.cylinders(spark, sf_dir)))


@query(""", a AS (SELECT *, sum(length) OVER (PARTITION BY tree_id ORDER BY cyl) AS along FROM cylinder WHERE branch_order = 0)
SELECT tree_id, round(200 * coalesce(min_by(radius, cyl) FILTER (WHERE along >= 1.3), max_by(radius, cyl)), 4) + 0.0 AS dbh_cm FROM a GROUP BY tree_id""", "cylinder")
def agg3_dbh_trunk(spark, sf_dir):
    return rounded(tree.breast_diameter(tables.cylinders(spark, sf_dir), trunk_only=True))


ORDERS = f""", o AS (SELECT tree_id, branch_order, count(DISTINCT branch) AS n_branches, sum({V}) AS volume, sum(length) AS length FROM cylinder WHERE branch_order > 0 GROUP BY ALL)"""


@query(ORDERS + """ SELECT tree_id, CAST(branch_order AS BIGINT) AS branch_order, n_branches, round(volume, 4) + 0.0 AS volume, round(length, 4) + 0.0 AS length,
  round(100.0 * n_branches / sum(n_branches) OVER t, 4) + 0.0 AS n_branches_pct, round(100 * volume / sum(volume) OVER t, 4) + 0.0 AS volume_pct, round(100 * length / sum(length) OVER t, 4) + 0.0 AS length_pct
  FROM o WINDOW t AS (PARTITION BY tree_id)""", "cylinder")
def agg4_by_order(spark, sf_dir):
    return rounded(tree.by_order(tables.cylinders(spark, sf_dir)).drop("volume_up_to", "length_up_to"))


@query(ORDERS + """ SELECT tree_id, CAST(branch_order AS BIGINT) AS branch_order, round(sum(volume) OVER t, 4) + 0.0 AS volume_up_to, round(sum(length) OVER t, 4) + 0.0 AS length_up_to
  FROM o WINDOW t AS (PARTITION BY tree_id ORDER BY branch_order)""", "cylinder")
def agg5_cumulative_by_order(spark, sf_dir):
    return rounded(tree.by_order(tables.cylinders(spark, sf_dir)).select("tree_id", "branch_order", "volume_up_to", "length_up_to"))


def _classes(where: str) -> str:
    return f""", c AS (SELECT *, CASE WHEN max(ceil(radius * 200)) OVER (PARTITION BY tree_id) < 3 THEN 2000 ELSE 200 END AS per_m FROM cylinder {where}),
s AS (SELECT tree_id, per_m, ceil(round(radius * per_m, 9)) AS size_class, sum({V}) AS volume, sum(length) AS length FROM c GROUP BY ALL)"""


@query(_classes("WHERE branch_order > 0") + """ SELECT tree_id, CAST(per_m AS BIGINT) AS per_m, CAST(size_class AS BIGINT) AS size_class, round(volume, 4) + 0.0 AS volume, round(length, 4) + 0.0 AS length,
  round(100 * volume / sum(volume) OVER (PARTITION BY tree_id), 4) + 0.0 AS volume_pct, round(100 * length / sum(length) OVER (PARTITION BY tree_id), 4) + 0.0 AS length_pct,
  round(sum(volume) OVER (PARTITION BY tree_id ORDER BY size_class), 4) + 0.0 AS volume_up_to FROM s""", "cylinder")
def agg6_branch_size_classes(spark, sf_dir):
    return rounded(tree.size_classes(tables.cylinders(spark, sf_dir)))


@query(_classes("") + """ SELECT tree_id, CAST(size_class AS BIGINT) AS size_class, round(sum(volume) OVER (PARTITION BY tree_id ORDER BY size_class), 4) + 0.0 AS volume_up_to FROM s""", "cylinder")
def agg7_cumulative_size_classes(spark, sf_dir):
    return rounded(tree.size_classes(tables.cylinders(spark, sf_dir), all_cylinders=True).select("tree_id", "size_class", "volume_up_to"))


@query(f"""SELECT tree_id, cyl, round(sum(length) OVER w, 4) + 0.0 AS along, round(200 * radius, 4) + 0.0 AS diameter_cm, round(sum({V}) OVER w, 4) + 0.0 AS volume_up_to,
  round(100 * sum({V}) OVER w / sum({V}) OVER (PARTITION BY tree_id), 4) + 0.0 AS volume_pct FROM cylinder WHERE branch_order = 0 WINDOW w AS (PARTITION BY tree_id ORDER BY cyl)""", "cylinder")
def agg8_taper(spark, sf_dir):
    return rounded(tree.taper(tables.cylinders(spark, sf_dir)))


@query(f""", b AS (SELECT tree_id, branch, branch_order, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length, min(cyl) AS first_cylinder FROM cylinder GROUP BY ALL)
SELECT b.tree_id, b.branch, CAST(b.branch_order AS BIGINT) AS branch_order, p.branch AS parent_branch, round(2 * f.radius, 4) + 0.0 AS diameter, round(b.volume, 4) + 0.0 AS volume, round(b.area, 4) + 0.0 AS area,
  round(b.length, 4) + 0.0 AS length, round(CASE WHEN p.ax IS NOT NULL THEN degrees(acos(least(greatest(f.ax * p.ax + f.ay * p.ay + f.az * p.az, -1.0), 1.0))) END, 3) + 0.0 AS angle, round(f.sz - min(f.sz) OVER (PARTITION BY b.tree_id), 4) + 0.0 AS height,
  round(degrees(atan2(f.ay, f.ax)), 4) + 0.0 AS azimuth, round(degrees(acos(least(greatest(f.az, -1.0), 1.0))), 4) + 0.0 AS zenith, b.first_cylinder
FROM b JOIN cylinder f ON f.tree_id = b.tree_id AND f.cyl = b.first_cylinder LEFT JOIN cylinder p ON p.tree_id = f.tree_id AND p.cyl = f.parent""", "cylinder")
def agg9_branch_table(spark, sf_dir):
    b = tree.branch_table(tables.cylinders(spark, sf_dir)).drop("cylinders")
    return rounded(b.withColumn("angle", F.round("angle", 3)))


@query("""SELECT b.tree_id, b.branch, coalesce(string_agg(CAST(c.branch AS VARCHAR), ',' ORDER BY c.branch), '') AS children, count(c.branch) AS n_children
  FROM branch b LEFT JOIN branch c ON c.tree_id = b.tree_id AND c.parent = b.branch GROUP BY ALL""", "branch")
def agg10_branch_children(spark, sf_dir):
    return rounded(tree.branch_children(tables.branches(spark, sf_dir)).withColumn("children", F.array_join("children", ",")))


def _bins(limit: str, value: str, by: str = "tree_id", table: str = "cylinder") -> str:
    """Dense bins of ``limit`` with volume, area, length."""
    return f""", f AS (SELECT {by}, CAST(floor({value}) AS BIGINT) AS bin, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length FROM {table} {limit} GROUP BY ALL),
d AS (SELECT {by}, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY {by})
SELECT d.{by}, d.bin, round(coalesce(volume, 0), 4) + 0.0 AS volume, round(coalesce(area, 0), 4) + 0.0 AS area, round(coalesce(length, 0), 4) + 0.0 AS length FROM d LEFT JOIN f ON d.{by} = f.{by} AND d.bin = f.bin"""


def _cylinder_bins(spark, sf_dir, value):
    return rounded(tree.distribution(tables.cylinders(spark, sf_dir), ["tree_id"], F.floor(value), {"volume": tree.volume(), "area": tree.area(), "length": F.col("length")}))


@query(_bins("", "round(radius * 200, 9)"), "cylinder")
def agg11_diameter_distribution(spark, sf_dir):
    return _cylinder_bins(spark, sf_dir, F.round(F.col("radius") * 200, 9))


@query(_bins("", "round(degrees(acos(az)) / 10, 6)"), "cylinder")
def agg11_zenith_distribution(spark, sf_dir):
    return _cylinder_bins(spark, sf_dir, F.round(F.degrees(F.acos("az")) / 10, 6))


@query(_bins("", "round((degrees(atan2(ay, ax)) + 180) / 10, 6)"), "cylinder")
def agg11_azimuth_distribution(spark, sf_dir):
    return _cylinder_bins(spark, sf_dir, F.round((F.degrees(F.atan2("ay", "ax")) + 180) / 10, 6))


@query(f""", b AS (SELECT tree_id, branch, branch_order, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length, min_by(sz, position) AS z FROM cylinder WHERE branch_order > 0 GROUP BY ALL),
f AS (SELECT tree_id, CAST(floor(round(z, 6)) AS BIGINT) AS bin, sum(volume) AS volume, sum(area) AS area, sum(length) AS length, count(*) AS n, sum(CASE WHEN branch_order = 1 THEN volume ELSE 0 END) AS volume_1,
  sum(CASE WHEN branch_order = 1 THEN length ELSE 0 END) AS length_1, count(*) FILTER (WHERE branch_order = 1) AS n_1 FROM b GROUP BY ALL),
d AS (SELECT tree_id, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY tree_id)
SELECT d.tree_id, d.bin, round(coalesce(volume, 0), 4) + 0.0 AS volume, round(coalesce(area, 0), 4) + 0.0 AS area, round(coalesce(length, 0), 4) + 0.0 AS length, coalesce(n, 0) AS n,
  round(coalesce(volume_1, 0), 4) + 0.0 AS volume_1, round(coalesce(length_1, 0), 4) + 0.0 AS length_1, coalesce(n_1, 0) AS n_1 FROM d LEFT JOIN f ON d.tree_id = f.tree_id AND d.bin = f.bin""", "cylinder")
def agg12_branch_height_distribution(spark, sf_dir):
    one = lambda c: F.when(F.col("branch_order") == 1, c).otherwise(0)
    b = tree.branch_table(tables.cylinders(spark, sf_dir).where("branch_order > 0"))
    base = tables.cylinders(spark, sf_dir).where("branch_order > 0 AND position = 1").select("tree_id", "branch", F.col("sz").alias("_z"))
    b = b.join(base, ["tree_id", "branch"])
    values = {
        "volume": F.col("volume"), "area": F.col("area"), "length": F.col("length"), "n": F.lit(1), "volume_1": one(F.col("volume")).cast("double"),
        "length_1": one(F.col("length")).cast("double"), "n_1": one(F.lit(1)),
    }
    return rounded(tree.distribution(b, ["tree_id"], F.floor(F.round("_z", 6)), values))


@query(f""", f AS (SELECT tree_id, CAST(branch_order AS BIGINT) AS bin, sum({V}) AS volume, sum({A}) AS area, sum(length) AS length, count(DISTINCT branch) AS n FROM cylinder WHERE branch_order > 0 GROUP BY ALL),
t AS (SELECT tree_id, greatest(max(branch_order), 1) AS top FROM cylinder GROUP BY tree_id), d AS (SELECT tree_id, unnest(range(1, top + 1)) AS bin FROM t)
SELECT d.tree_id, d.bin AS branch_order, round(coalesce(volume, 0), 4) + 0.0 AS volume, round(coalesce(area, 0), 4) + 0.0 AS area, round(coalesce(length, 0), 4) + 0.0 AS length, coalesce(n, 0) AS n
FROM d LEFT JOIN f ON d.tree_id = f.tree_id AND d.bin = f.bin""", "cylinder")
def agg13_order_distribution(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    top = c.groupBy("tree_id").agg(F.greatest(F.max("branch_order"), F.lit(1)).alias("_top")).select("tree_id", F.explode(F.sequence(F.lit(1), "_top")).alias("branch_order"))
    found = c.where("branch_order > 0").groupBy("tree_id", "branch_order").agg(F.sum(tree.volume()).alias("volume"), F.sum(tree.area()).alias("area"), F.sum("length").alias("length"), F.countDistinct("branch").alias("n"))
    return rounded(top.join(found, ["tree_id", "branch_order"], "left").fillna(0))


@query(f""", e AS (SELECT *, least(sz, sz + length * az) AS lo, greatest(sz, sz + length * az) AS hi FROM cylinder),
g AS (SELECT *, lo - min(lo) OVER (PARTITION BY tree_id) AS a, hi - min(lo) OVER (PARTITION BY tree_id) AS b FROM e),
u AS (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(floor(b) AS BIGINT) + 1)) AS bin FROM g),
s AS (SELECT *, CASE WHEN b > a THEN (least(b, bin + 1) - greatest(a, bin)) / (b - a) ELSE 1 END AS share FROM u)
SELECT tree_id, bin, round(sum(share * {V}), 4) + 0.0 AS volume, round(sum(share * {A}), 4) + 0.0 AS area, round(sum(share * length), 4) + 0.0 AS length FROM s GROUP BY tree_id, bin""", "cylinder")
def agg14_height_bins(spark, sf_dir):
    return rounded(tree.height_bins(tables.cylinders(spark, sf_dir)))


@query(f"""SELECT CAST(least(ceil(round(radius * 200, 9)), 41) AS BIGINT) AS size_class, round(sum({V}) / count(DISTINCT tree_id), 4) + 0.0 AS mean_volume, count(*) AS n FROM cylinder GROUP BY ALL""", "cylinder")
def agg27_mean_volume_by_class(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir).withColumn("size_class", F.least(F.ceil(F.round(F.col("radius") * 200, 9)), F.lit(41)))
    return rounded(c.groupBy("size_class").agg((F.sum(tree.volume()) / F.countDistinct("tree_id")).alias("mean_volume"), F.count(F.lit(1)).alias("n")))


@query(f""", v AS (SELECT CAST(least(ceil(round(radius * 200, 9)), 41) AS BIGINT) AS size_class, sum({V}) AS volume FROM cylinder GROUP BY ALL)
SELECT size_class, round(sum(volume) OVER (ORDER BY size_class DESC), 3) + 0.0 AS volume_over FROM v""", "cylinder")
def agg27_volume_over_class(spark, sf_dir):
    """At most 41 classes meet in the window."""
    from pyspark.sql import Window

    c = tables.cylinders(spark, sf_dir).withColumn("size_class", F.least(F.ceil(F.round(F.col("radius") * 200, 9)), F.lit(41)))
    v = c.groupBy("size_class").agg(F.sum(tree.volume()).alias("_v"))
    return rounded(v.select("size_class", F.sum("_v").over(Window.orderBy(F.desc("size_class"))).alias("volume_over")), 3)


@query(f""", b AS (SELECT tree_id, branch, branch_order, min_by(sz, position) AS z, min_by(degrees(acos(az)), position) AS zenith FROM cylinder GROUP BY ALL)
SELECT tree_id, CAST(branch_order AS BIGINT) AS branch_order, count(*) AS n, round(min(zenith), 4) + 0.0 AS least, round(avg(zenith), 4) + 0.0 AS mean, round(max(zenith), 4) + 0.0 AS most,
  round(stddev_samp(zenith), 4) + 0.0 AS sd FROM b GROUP BY tree_id, branch_order""", "cylinder")
def agg31_zenith_by_order(spark, sf_dir):
    b = tree.branch_table(tables.cylinders(spark, sf_dir))
    return rounded(b.groupBy("tree_id", "branch_order").agg(F.count(F.lit(1)).alias("n"), F.min("zenith").alias("least"), F.avg("zenith").alias("mean"), F.max("zenith").alias("most"), F.stddev_samp("zenith").alias("sd")))


WIDE = ", ".join(f"coalesce(max(CASE WHEN branch_order = {k} THEN {c} END), 0) AS {c}_{k}" for c in ("n_branches", "volume", "length") for k in range(1, 7))
ROUND = ", ".join([f"coalesce(n_branches_{k}, 0) AS n_branches_{k}" for k in range(1, 7)] + [f"round(coalesce({c}_{k}, 0), 3) + 0.0 AS {c}_{k}" for c in ("volume", "length") for k in range(1, 7)])


@query(ORDERS + f""", w AS (SELECT tree_id, {WIDE} FROM o GROUP BY tree_id), t AS (SELECT tree_id, sum({V}) AS total_volume, sum(length) AS total_length FROM cylinder GROUP BY tree_id)
SELECT tree_id, round(total_volume, 3) + 0.0 AS total_volume, round(total_length, 3) + 0.0 AS total_length, {ROUND} FROM t LEFT JOIN w USING (tree_id)""", "cylinder")
def treedata_wide(spark, sf_dir):
    a = tree.attributes(tables.cylinders(spark, sf_dir)).withColumn("total_length", F.col("trunk_length") + F.col("branch_length"))
    return rounded(a.select("tree_id", "total_volume", "total_length", *[f"{c}_{k}" for c in ("n_branches", "volume", "length") for k in range(1, 7)]), 3)


@query("""SELECT tree_id, branch, position, round(sum(length) OVER w, 4) + 0.0 AS along, round(sum(length) OVER w - length / 2, 4) + 0.0 AS middle FROM cylinder WINDOW w AS (PARTITION BY branch ORDER BY position)""", "cylinder")
def win1_running_length(spark, sf_dir):
    from pyspark.sql import Window

    along = F.sum("length").over(Window.partitionBy("branch").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(tables.cylinders(spark, sf_dir).select("tree_id", "branch", "position", along.alias("along"), (along - F.col("length") / 2).alias("middle")))


@query("""SELECT tree_id, branch, position, round(ax * lag(ax) OVER w + ay * lag(ay) OVER w + az * lag(az) OVER w, 4) + 0.0 AS along_previous FROM cylinder WINDOW w AS (PARTITION BY branch ORDER BY position)""", "cylinder")
def win4_axis_continuity(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("branch").orderBy("position")
    dot = sum((F.col(a) * F.lag(a).over(w) for a in ("ay", "az")), F.col("ax") * F.lag("ax").over(w))
    return rounded(tables.cylinders(spark, sf_dir).select("tree_id", "branch", "position", dot.alias("along_previous")))


@query(""", t AS (SELECT *, CASE WHEN radius > 0.333 * first_value(radius) OVER w AND coalesce(ax * lag(ax) OVER w + ay * lag(ay) OVER w + az * lag(az) OVER w > 0.97, true) THEN 1 ELSE 0 END AS ok
  FROM cylinder WHERE branch_order = 0 WINDOW w AS (PARTITION BY tree_id ORDER BY cyl)), p AS (SELECT *, min(ok) OVER (PARTITION BY tree_id ORDER BY cyl) AS all_ok FROM t)
SELECT tree_id, count(*) AS n, round(sum(length), 4) + 0.0 AS length FROM p WHERE all_ok = 1 GROUP BY tree_id""", "cylinder")
def win5_straight_trunk(spark, sf_dir):
    return rounded(tree.straight_prefix(tables.cylinders(spark, sf_dir)).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")))


@query("""SELECT tree_id, branch, position, round(min(radius) OVER (PARTITION BY tree_id, branch ORDER BY position), 4) + 0.0 AS radius FROM cylinder""", "cylinder")
def old4_monotone_radii(spark, sf_dir):
    return rounded(tree.monotone_radii(tables.cylinders(spark, sf_dir)).select("tree_id", "branch", "position", "radius"))


@query("""SELECT c.tree_id, c.cyl, p.cyl AS parent, round(c.radius / p.radius, 4) + 0.0 AS radius_ratio FROM cylinder c LEFT JOIN cylinder p ON p.tree_id = c.tree_id AND p.cyl = c.parent""", "cylinder")
def joi7_parent_cylinder(spark, sf_dir):
    c = tables.cylinders(spark, sf_dir)
    p = c.select("tree_id", F.col("cyl").alias("parent"), F.col("radius").alias("_r"))
    return rounded(c.join(p, ["tree_id", "parent"], "left").select("tree_id", "cyl", F.when(F.col("_r").isNotNull(), F.col("parent")).alias("parent"), (F.col("radius") / F.col("_r")).alias("radius_ratio")))


@query("""SELECT tree_id, branch FROM branch b WHERE NOT EXISTS (SELECT 1 FROM branch c WHERE c.tree_id = b.tree_id AND c.parent = b.branch)""", "branch")
def joi13_childless_branches(spark, sf_dir):
    b = tables.branches(spark, sf_dir)
    return b.join(b.select("tree_id", F.col("parent").alias("branch")), ["tree_id", "branch"], "left_anti").select("tree_id", "branch")
