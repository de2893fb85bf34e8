"""Queries over clouds, light-meter readings, rasters and model runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.functions import rounding
from canopia.operators import inventory, lightmeter, raster, runs
from canopia.plans.oracle import with_tables
from canopia.plans.tree_queries import rounded
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


SLICE = """, h AS (SELECT tree_id, min(z) AS z0, max(z) - min(z) AS height FROM points GROUP BY tree_id),
slice AS (SELECT p.*, height FROM points p JOIN h USING (tree_id) WHERE (height > 1.3 AND z - z0 > 1.27 AND z - z0 < 1.33) OR (height <= 1.3 AND z - z0 > height - 0.08 AND z - z0 < height - 0.02))"""
CIRCLE = SLICE + """, m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my FROM slice GROUP BY tree_id), c AS (SELECT tree_id, x - mx AS u, y - my AS v, mx, my FROM slice JOIN m USING (tree_id)),
s AS (SELECT tree_id, count(*) AS n, max(mx) AS mx, max(my) AS my, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * u * u + u * v * v) AS ru, sum(v * v * v + v * u * u) AS rv FROM c GROUP BY tree_id),
e AS (SELECT tree_id, n, mx + (ru * vv - rv * uv) / (2 * (uu * vv - uv * uv)) AS xc, my + (rv * uu - ru * uv) / (2 * (uu * vv - uv * uv)) AS yc FROM s WHERE abs(uu * vv - uv * uv) > 1e-18),
circle AS (SELECT tree_id, max(n) AS n, max(xc) AS xc, max(yc) AS yc, avg(sqrt((x - xc) * (x - xc) + (y - yc) * (y - yc))) AS radius FROM slice JOIN e USING (tree_id) GROUP BY tree_id)"""


@query(CIRCLE + """ SELECT tree_id, round_even(xc, 2) + 0.0 AS xc, round_even(yc, 2) + 0.0 AS yc, round_even(200 * radius, 2) + 0.0 AS dbh_cm, round_even(h.height, 2) + 0.0 AS height FROM h LEFT JOIN circle USING (tree_id)""", "points")
def inventory_table(spark, sf_dir):
    return inventory.inventory(tables.points(spark, sf_dir))


@query(SLICE + " SELECT tree_id, pid, round(z, 4) + 0.0 AS z FROM slice", "points")
def fil1_breast_slice(spark, sf_dir):
    return rounded(inventory.breast_slice(tables.points(spark, sf_dir)).select("tree_id", "pid", "z"))


@query(CIRCLE + " SELECT tree_id, n, round(xc, 4) + 0.0 AS xc, round(yc, 4) + 0.0 AS yc, round(radius, 4) + 0.0 AS radius FROM circle", "points")
def agg25_circle_fit(spark, sf_dir):
    p = inventory.breast_slice(tables.points(spark, sf_dir))
    return rounded(inventory.circle_fit(p).where("xc IS NOT NULL").select("tree_id", "n", "xc", "yc", "radius"))


@query(CIRCLE + """ SELECT tree_id, CAST(k AS BIGINT) AS k, round(xc + radius * cos(k * 2 * 3.141592653589793 / 200), 4) + 0.0 AS x, round(yc + radius * sin(k * 2 * 3.141592653589793 / 200), 4) + 0.0 AS y
  FROM (SELECT *, unnest(range(0, 201)) AS k FROM circle)""", "points")
def snk11_circle_outline(spark, sf_dir):
    return rounded(inventory.circle_outline(inventory.circle_fit(inventory.breast_slice(tables.points(spark, sf_dir))).where("xc IS NOT NULL")))


@query("""SELECT tree_id, round(min(x), 4) + 0.0 AS x0, round(max(x), 4) + 0.0 AS x1, round(min(y), 4) + 0.0 AS y0, round(max(y), 4) + 0.0 AS y1, round(min(z), 4) + 0.0 AS z0, round(max(z), 4) + 0.0 AS z1, count(*) AS n
  FROM points GROUP BY tree_id""", "points")
def agg29_bounding_box(spark, sf_dir):
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    return rounded(tables.points(spark, sf_dir).groupBy("tree_id").agg(*ends, F.count(F.lit(1)).alias("n")))


@query("""SELECT tree_id, round(covar_samp(x, x), 6) + 0.0 AS xx, round(covar_samp(x, y), 6) + 0.0 AS xy, round(covar_samp(x, z), 6) + 0.0 AS xz, round(covar_samp(y, y), 6) + 0.0 AS yy, round(covar_samp(y, z), 6) + 0.0 AS yz,
  round(covar_samp(z, z), 6) + 0.0 AS zz FROM points GROUP BY tree_id""", "points")
def agg26_covariance(spark, sf_dir):
    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return rounded(tables.points(spark, sf_dir).groupBy("tree_id").agg(*[F.covar_samp(p[0], p[1]).alias(p) for p in pairs]), 6)


NEAR = """, b AS (SELECT * FROM reading WHERE kind = 'B'), a AS (SELECT * FROM reading WHERE kind = 'A'),
near AS (SELECT b.day, b.seq, b.micros AS b_micros, b.value AS b_value, a.micros AS a_micros, a.value AS a_value,
  row_number() OVER (PARTITION BY b.seq ORDER BY abs(a.micros - b.micros), a.micros DESC, a.seq) AS k FROM b JOIN a ON a.day = b.day)"""


@query(NEAR + " SELECT strftime(day, '%Y-%m-%d') AS day, seq, b_micros, a_micros, round(b_value, 4) + 0.0 AS b_value, round(a_value, 4) + 0.0 AS a_value FROM near WHERE k = 1", "reading")
def joi1_nearest_reading(spark, sf_dir):
    return rounded(lightmeter.nearest_reading(tables.readings(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd")))


GAPS = NEAR + """, gap AS (SELECT strftime(day, '%Y-%m-%d') AS day, """ + ", ".join(f"pow(least(greatest(b_value / a_value, 0.01), 0.99), 1.0 / {k}) AS g{k}" for k in range(1, 6)) + " FROM near WHERE k = 1 AND a_value > 0)"
RINGS = [f"g{k}" for k in range(1, 6)]


def _gaps(spark, sf_dir):
    near = lightmeter.nearest_reading(tables.readings(spark, sf_dir)).where("a_value > 0")
    share = F.least(F.greatest(F.col("b_value") / F.col("a_value"), F.lit(0.01)), F.lit(0.99))
    return near.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.pow(share, F.lit(1.0 / k)).alias(f"g{k}") for k in range(1, 6)])


@query(GAPS + " SELECT day, " + ", ".join(f"round(avg({g}), 4) + 0.0 AS {g}_mean, round(stddev_pop({g}), 4) + 0.0 AS {g}_sd, round(100 * stddev_pop({g}) / avg({g}), 4) + 0.0 AS {g}_sd_pct" for g in RINGS) + " FROM gap GROUP BY day", "reading")
def agg19_gap_statistics(spark, sf_dir):
    return rounded(lightmeter.gap_statistics(_gaps(spark, sf_dir), ["day"], RINGS))


def _sum(of: str) -> str:
    return " + ".join(f"-ln({of.format(k)}) / {d} * {w}" for k, d, w in zip(range(1, 6), lightmeter.DISTANCES, lightmeter.WEIGHTS, strict=True))


@query(GAPS + f" SELECT day, round(2 * ({_sum('avg(g{})')}), 4) + 0.0 AS paie FROM gap GROUP BY day", "reading")
def agg20_effective_area_index(spark, sf_dir):
    return rounded(lightmeter.effective_area_index(_gaps(spark, sf_dir), ["day"], RINGS))


@query(GAPS + f" SELECT day, round(avg(2 * ({_sum('g{}')})), 4) + 0.0 AS pai, count(*) AS n FROM gap GROUP BY day", "reading")
def agg21_area_index(spark, sf_dir):
    return rounded(lightmeter.area_index(_gaps(spark, sf_dir), ["day"], RINGS))


@query(GAPS + " SELECT day, round(2 * -ln(avg(g4)) / 1.662, 4) + 0.0 AS paie, round(avg(2 * -ln(g4) / 1.662), 4) + 0.0 AS pai FROM gap GROUP BY day", "reading")
def agg22_fourth_ring_only(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    ring = (lightmeter.DISTANCES[3],), (1.0,)
    both = lightmeter.effective_area_index(g, ["day"], ["g4"], *ring).join(lightmeter.area_index(g, ["day"], ["g4"], *ring).drop("n"), "day")
    return rounded(both)


@query("""SELECT band, round(min(value), 4) + 0.0 AS least, round(max(value), 4) + 0.0 AS most, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) + 0.0 AS sd, count(DISTINCT value) AS n_distinct FROM pixel GROUP BY band""", "pixel")
def agg23_raster_statistics(spark, sf_dir):
    return rounded(raster.statistics(tables.pixels(spark, sf_dir), ["band"]))


@query(""", f AS (SELECT DISTINCT image FROM pixel ORDER BY image LIMIT 50) SELECT band, "row", col, round(sum(value), 4) + 0.0 AS value, count(*) AS n_images FROM pixel WHERE image IN (SELECT image FROM f) GROUP BY ALL""", "pixel")
def agg24_sum_first_images(spark, sf_dir):
    """The limit is the operator's own: the first images of a set."""
    return rounded(raster.sum_images(tables.pixels(spark, sf_dir), 50))


@query("""SELECT image, count(DISTINCT band) AS bands, max("row") + 1 AS "rows", max(col) + 1 AS cols FROM pixel GROUP BY image""", "pixel")
def agg24_image_sizes(spark, sf_dir):
    return rounded(raster.sizes(tables.pixels(spark, sf_dir)))


@query(""", e AS (SELECT band, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM pixel GROUP BY band)
SELECT image, band, "row", col, round(least(greatest((value - lo) / (hi - lo), 0.0), 1.0), 4) + 0.0 AS value FROM pixel JOIN e USING (band)""", "pixel")
def fun13_percentile_stretch(spark, sf_dir):
    return rounded(raster.stretch(tables.pixels(spark, sf_dir), ["band"], 0.025, 0.975))


@query(""", m AS (SELECT image, "row", col, max(value) AS v FROM pixel GROUP BY ALL), t AS (SELECT image, quantile_cont(v, 0.99) AS top FROM m GROUP BY image)
SELECT image, band, "row", col, CAST(floor(255 * CASE WHEN value / top = 0 OR value / top > 1 THEN 1 ELSE value / top END) AS BIGINT) AS byte FROM pixel JOIN t USING (image)""", "pixel")
def fun14_to_bytes(spark, sf_dir):
    return raster.to_bytes(tables.pixels(spark, sf_dir), ["image"]).select("image", "band", "row", "col", "byte")


@query("""SELECT image, band, 7 - "row" AS "row", col, round(value, 4) + 0.0 AS value FROM pixel""", "pixel")
def fun16_turned_raster(spark, sf_dir):
    return rounded(raster.turned(tables.pixels(spark, sf_dir), 8))


@query("""SELECT file, split_part(file, '-', 1) AS tree, CAST(split_part(split_part(file, '-', 1), '_', 4) AS BIGINT) AS tree_number, regexp_extract(file, '^[^-]*-(.*)-[^-]*$', 1) AS parameters,
  CAST(regexp_extract(file, '-([0-9]+)\\.mat$', 1) AS BIGINT) AS iteration FROM run""", "run")
def fun11_run_names(spark, sf_dir):
    return rounded(runs.named(tables.runs(spark, sf_dir)).select("file", "tree", "tree_number", "parameters", "iteration"))


@query(""", n AS (SELECT *, split_part(file, '-', 1) AS tree FROM run) SELECT tree, count(*) AS n, round(avg(volume), 3) + 0.0 AS volume_mean, round(stddev_samp(volume), 3) + 0.0 AS volume_sd, round(avg(height), 3) + 0.0 AS height_mean,
  round(stddev_samp(height), 3) + 0.0 AS height_sd, round(avg(dbh), 3) + 0.0 AS dbh_mean, round(stddev_samp(dbh), 3) + 0.0 AS dbh_sd, '0.08-0.09-5-0.04-0.045-3-5-1' AS parameters FROM n GROUP BY tree""", "run")
def agg16_over_runs(spark, sf_dir):
    return rounded(runs.over_runs(tables.runs(spark, sf_dir), ["volume", "height", "dbh"]), 3)


@query(""", n AS (SELECT split_part(file, '-', 1) AS tree, volume, height, dbh FROM run), l AS (SELECT tree, 'volume' AS attribute, volume AS value FROM n UNION ALL SELECT tree, 'height', height FROM n UNION ALL SELECT tree, 'dbh', dbh FROM n)
SELECT tree, attribute, round(avg(value), 3) + 0.0 AS mean, round(min(value), 3) + 0.0 AS least, round(max(value), 3) + 0.0 AS most, round(stddev_samp(value), 3) + 0.0 AS sd, round(100 * stddev_samp(value) / nullif(avg(value), 0), 3) + 0.0 AS cv_pct
FROM l GROUP BY tree, attribute""", "run")
def agg17_spread(spark, sf_dir):
    return rounded(runs.spread(tables.runs(spark, sf_dir), ["volume", "height", "dbh"]), 3)


@query(""", t AS (SELECT DISTINCT split_part(file, '-', 1) AS tree FROM run) SELECT t.tree, count(*) AS n FROM t JOIN run ON starts_with(run.file, t.tree) GROUP BY t.tree""", "run")
def joi11_prefix_runs(spark, sf_dir):
    f = tables.runs(spark, sf_dir)
    return runs.runs_of_prefix(runs.named(f).select("tree").distinct(), f, exact=False).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query(""", t AS (SELECT DISTINCT split_part(file, '-', 1) AS tree FROM run) SELECT tree FROM t""", "run")
def srt4_trees(spark, sf_dir):
    return runs.named(tables.runs(spark, sf_dir)).select("tree").distinct()


@query(""", n AS (SELECT *, CAST(split_part(split_part(file, '-', 1), '_', 4) AS BIGINT) AS tree_number FROM run) SELECT n.file, c.c_mktsegment AS species FROM n LEFT JOIN customer c ON c.c_custkey = n.tree_number""", "run")
def joi10_species(spark, sf_dir):
    species = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_number"), F.col("c_mktsegment").alias("species"))
    return runs.named(tables.runs(spark, sf_dir)).join(species, "tree_number", "left").select("file", "species")


@query("""SELECT file, CASE WHEN abs(volume) > 100 THEN round(volume, 0) WHEN abs(volume) > 10 THEN round(volume, 1) WHEN abs(volume) > 1 THEN round(volume, 2) ELSE round(volume, 3) END + 0.0 AS volume,
  CASE WHEN abs(height) > 100 THEN round(height, 0) WHEN abs(height) > 10 THEN round(height, 1) WHEN abs(height) > 1 THEN round(height, 2) ELSE round(height, 3) END + 0.0 AS height FROM run""", "run")
def fun7_magnitude_rounding(spark, sf_dir):
    return tables.runs(spark, sf_dir).select("file", rounding.by_magnitude(F.col("volume")).alias("volume"), rounding.by_magnitude(F.col("height").cast("double")).alias("height"))
