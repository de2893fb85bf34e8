"""Neighbourhoods in point clouds: voxels, radius joins, density filters and cover sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.functions.vectors import cross, dot, eigenvalues, norm
from canopia.plans.shared import broadcast_if_small, discard, materialize


def voxels(points: DataFrame, edge: float) -> DataFrame:
    """Points with the cell ``cx, cy, cz`` of a grid that starts at their tree's lowest corner."""
    low = points.groupBy("tree_id").agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    cell = lambda c: F.floor((F.col(c) - F.col(f"_{c}")) / edge).cast("long").alias(f"c{c}")
    return points.join(low, "tree_id").select(*points.columns, *[cell(c) for c in "xyz"])


def _cells(points: DataFrame, edge: float, reach: int) -> DataFrame:
    grid = {f"_c{c}": F.floor(F.col(c) / edge) for c in "xyz"}
    p = points.withColumns(grid)
    if reach:
        step = F.sequence(F.lit(-reach), F.lit(reach))
        for c in "xyz":
            p = p.withColumn("_d", F.explode(step)).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_d")).drop("_d")
    return p


def radius_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``tree_id, pid_a, pid_b, dist`` of all points of ``b`` less than ``radius`` from a point of ``a`` in one tree, itself included.

    Each point of ``a`` looks into the 27 cells around it: an equality join on the cell, so no more pairs are made than
    cells this size hold; Spark splits the cells that hold too many. Spark does not know that a point becomes 27 rows and would send them
    all to the driver to be broadcast, so the join is told to be one of sorted rows.
    """
    left = _cells(a.select("tree_id", F.col("pid").alias("pid_a"), "x", "y", "z"), radius, 1)
    right = _cells(b.select("tree_id", F.col("pid").alias("pid_b"), *[F.col(c).alias(c) for c in "xyz"]), radius, 0).select("tree_id", "pid_b", *[F.col(c).alias(f"_{c}") for c in "xyz"], "_cx", "_cy", "_cz")
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"), F.lit(0.0)))
    return left.join(right.hint("merge"), ["tree_id", "_cx", "_cy", "_cz"]).withColumn("dist", d).where(F.col("dist") < radius).select("tree_id", "pid_a", "pid_b", "dist")


def varying_radius_pairs(a: DataFrame, b: DataFrame, radius: Column, largest: float, edge: float) -> DataFrame:
    """As :func:`radius_pairs`, with a radius for each row of ``a`` up to ``largest``; cells of ``edge`` are looked up as far as that."""
    left = _cells(a.withColumn("_r", radius).select("tree_id", F.col("pid").alias("pid_a"), "x", "y", "z", "_r"), edge, -int(-largest // edge))
    right = _cells(b.select("tree_id", F.col("pid").alias("pid_b"), "x", "y", "z"), edge, 0).select("tree_id", "pid_b", *[F.col(c).alias(f"_{c}") for c in "xyz"], "_cx", "_cy", "_cz")
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"), F.lit(0.0)))
    return left.join(right.hint("merge"), ["tree_id", "_cx", "_cy", "_cz"]).withColumn("dist", d).where(F.col("dist") < F.col("_r")).select("tree_id", "pid_a", "pid_b", "dist")


def without_repeats(points: DataFrame) -> DataFrame:
    """Of points at one place that with the smallest number; places with a missing or undefined coordinate go."""
    known = points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    return known.groupBy("tree_id", "x", "y", "z").agg(F.min("pid").alias("pid"))


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    """Per point: how many points of its tree are less than ``radius`` away, itself included."""
    return radius_pairs(points, points, radius).groupBy("tree_id", F.col("pid_a").alias("pid")).agg(F.count(F.lit(1)).alias("n"))


def density_filter(points: DataFrame, radius: float, least: int, plain_layers: int = 2) -> DataFrame:
    """Points with enough neighbours for their height: ``least`` in the ``plain_layers`` lowest metres (two; three in the older version), above in proportion
    to the layer's mean, but a third at least."""
    n = points.join(neighbour_counts(points, radius), ["tree_id", "pid"])
    low = points.groupBy("tree_id").agg(F.min("z").alias("_low"))
    n = n.join(low, "tree_id").withColumn("layer", F.floor(F.col("z") - F.col("_low")).cast("long") + 1)
    mean = n.groupBy("tree_id", "layer").agg(F.ceil(F.avg("n")).alias("_mean"))
    second = mean.where(F.col("layer") == plain_layers).select("tree_id", F.col("_mean").alias("_second"))
    scaled = F.greatest(F.ceil(F.col("_mean") * least / F.col("_second")), F.ceil(F.lit(least / 3)))
    limit = F.when((F.col("layer") <= plain_layers) | F.col("_second").isNull(), F.lit(least)).otherwise(scaled)
    return n.join(mean, ["tree_id", "layer"]).join(second, "tree_id", "left").where(F.col("n") >= limit).select("tree_id", "pid", "x", "y", "z", "layer", "n")


def cover(points: DataFrame, dmin: float, rcov: float, nmin: int, seed: int | None = None, max_rounds: int = 10_000, sizes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cover sets: ``centres`` (tree_id, pid) and ``members`` (tree_id, pid, centre, dist).

    The centres are those that a walk over the points finds which takes each point with ``nmin`` points within ``rcov`` that no
    centre before is nearer to than ``dmin``; the walk is in order of ``pid``, or of a hash of it under ``seed``. They are found in
    rounds instead: a point is taken if no open point before it would shut it out; with a ``seed`` there are few rounds, in order of ``pid`` a line of
    points takes as many as it has centres. Members go to the nearest centre within ``rcov``, of equally near ones to the earlier.

    ``sizes`` names a column of relative sizes from 1 to 256: the centre's ``dmin`` shrinks with it, to a half at the least, and its ``rcov`` by as much. Then
    a large centre may shut out a small one that would not shut it out, so what counts is the distance of the earlier.
    """
    rank = lambda p: F.struct((F.col(p) if seed is None else F.xxhash64(p, F.lit(seed))).alias("o"), F.col(p).alias("p"))
    apart, least = (F.lit(dmin), dmin) if sizes is None else ((F.col(sizes) / 512 + 0.5) * dmin, dmin / 2)

    def within(a: DataFrame, b: DataFrame, radius: Column, largest: float) -> DataFrame:
        return radius_pairs(a, b, largest) if sizes is None else varying_radius_pairs(a, b, radius, largest, largest)

    known = points.where(" AND ".join(f"{c} - {c} = 0" for c in "xyz")).withColumn("_apart", apart.cast("double")).where(F.col("_apart").isNotNull())
    able = known
    if nmin > 1:  # a point is in its own ball
        inner = (least + rcov - dmin) / 1.7321
        if inner > 0:  # all points of a cell this wide are in each other's balls
            at = [f"_c{c}" for c in "xyz"]
            known = materialize(_cells(known, inner, 0).withColumn("_crowd", F.count(F.lit(1)).over(Window.partitionBy("tree_id", *at)) >= nmin).drop(*at), "crowds")
            few = known.where("NOT _crowd")
        else:
            few = known
        dense = within(few, points, apart + (rcov - dmin), rcov).groupBy("tree_id", F.col("pid_a").alias("pid")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nmin).select("tree_id", "pid")
        able = few.join(dense, ["tree_id", "pid"], "left_semi")
        able = able if inner <= 0 else known.where("_crowd").unionByName(able)
    # In a cell this narrow the first open point shuts out all others, so of each cell only that is looked at: against the points around it that come before it, and then
    # against those that come after it if it is taken. That is so many looks at a point as there are cells around it, however many points there are.
    edge = least / 1.7321
    reach = -int(-dmin // edge)
    at = ["tree_id", "_cx", "_cy", "_cz"]
    still = materialize(_cells(able, edge, 0).select(*at, rank("pid").alias("_o"), "x", "y", "z", "_apart"), "open")
    apart_from = F.sqrt(sum(((F.col(c) - F.col(f"_f{c}")) * (F.col(c) - F.col(f"_f{c}")) for c in "xyz"), F.lit(0.0)))

    def around(firsts: DataFrame) -> DataFrame:
        f = firsts.select("tree_id", F.col("_o").alias("_fo"), *[F.col(c).alias(f"_f{c}") for c in "xyz"], F.col("_apart").alias("_fapart"), *at[1:])
        for c in at[1:]:
            f = f.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
        return still.join(f.hint("merge"), at)

    taken = None
    for k in range(max_rounds):
        firsts = materialize(still.groupBy(*at).agg(F.min(F.struct("_o", "x", "y", "z", "_apart")).alias("_f")).select(*at, "_f.*"), "firsts")
        shut = around(firsts).where((F.col("_o") < F.col("_fo")) & (apart_from < F.col("_apart"))).select("tree_id", F.col("_fo").alias("_o")).distinct()
        new = materialize(firsts.join(shut, ["tree_id", "_o"], "left_anti"), "centres")
        discard(firsts)
        taken = new if taken is None else taken.unionByName(new)
        if k % 20 == 19:  # a flat table in place of a long union
            taken = materialize(taken, "centres")
        gone = around(new).where((F.col("_o") >= F.col("_fo")) & (apart_from < F.col("_fapart"))).select("tree_id", "_o").distinct()
        after = materialize(still.join(gone, ["tree_id", "_o"], "left_anti"), "open")
        discard(still)
        still = after
        if still.isEmpty():
            break
    else:
        raise RuntimeError(f"cover did not settle in {max_rounds} rounds")
    taken = taken.select("tree_id", F.col("_o.p").alias("pid"))
    centres = points.join(taken, ["tree_id", "pid"], "left_semi")
    ball = within(centres, points, apart + (rcov - dmin), rcov).withColumn("pid", F.col("pid_a"))
    best = ball.groupBy("tree_id", "pid_b").agg(F.min(F.struct("dist", rank("pid").alias("r"))).alias("_b"))
    return taken, best.select("tree_id", F.col("pid_b").alias("pid"), F.col("_b.r.p").alias("centre"), F.col("_b.dist").alias("dist"))


def cover_neighbours(points: DataFrame, members: DataFrame, rcov: float) -> DataFrame:
    """Both directions of ``tree_id, a, b``: sets one of whose centres has a point of the other within ``rcov``."""
    centres = points.join(members.select("tree_id", F.col("centre").alias("pid")).distinct(), ["tree_id", "pid"], "left_semi")
    ball = radius_pairs(centres, points, rcov).select("tree_id", F.col("pid_a").alias("a"), F.col("pid_b").alias("pid"))
    one = ball.join(members.select("tree_id", "pid", F.col("centre").alias("b")), ["tree_id", "pid"]).where("a <> b").select("tree_id", "a", "b")
    return one.unionByName(one.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def true_neighbours(points: DataFrame, members: DataFrame, dmin: float, rcov: float) -> DataFrame:
    """Both directions of ``tree_id, a, b``: neighbours as :func:`cover_neighbours` finds them, without those beyond a gap or behind another set.

    Along the line between the centres, a set's own points and those of the other reach so far towards each other: the pair stays if that is over 0.8 of
    the distance, or leaves a gap under half of ``dmin``. A set without any at 0.8 looks again with 0.6 and half of ``rcov``. One with one or two left takes the
    nearest set on the far side of its nearest one, too, if the gap there is under ``rcov``. A single candidate always stays; what one side keeps both have.
    """
    at = lambda n: points.select("tree_id", F.col("pid").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in "xyz"])
    own = members.select("tree_id", "pid", "centre")
    ball = radius_pairs(points.join(own.select("tree_id", F.col("centre").alias("pid")).distinct(), ["tree_id", "pid"], "left_semi"), points, rcov)
    pairs = ball.select("tree_id", F.col("pid_a").alias("a"), F.col("pid_b").alias("pid")).join(own.withColumnRenamed("centre", "b"), ["tree_id", "pid"]).where("a <> b").select("tree_id", "a", "b").distinct()
    pairs = pairs.join(at("a"), ["tree_id", "a"]).join(at("b"), ["tree_id", "b"])
    line = {c: F.col(f"{c}_b") - F.col(f"{c}_a") for c in "xyz"}
    pairs = pairs.withColumn("_l", F.sqrt(sum((v * v for v in line.values()), F.lit(0.0))))
    pairs = materialize(pairs.select("tree_id", "a", "b", "_l", *[(v / F.col("_l")).alias(f"_t{c}") for c, v in line.items()]), "pairs")
    from_centre = own.join(points, ["tree_id", "pid"]).join(at("centre"), ["tree_id", "centre"]).select("tree_id", "centre", *[(F.col(c) - F.col(f"{c}_centre")).alias(f"_v{c}") for c in "xyz"])
    along = sum((F.col(f"_v{c}") * F.col(f"_t{c}") for c in "yz"), F.col("_vx") * F.col("_tx"))
    reach = lambda side, f: pairs.join(from_centre.withColumnRenamed("centre", side), ["tree_id", side]).groupBy("tree_id", "a", "b").agg(f(along).alias(f"_{side}"))
    c = pairs.join(reach("a", F.max), ["tree_id", "a", "b"]).join(reach("b", F.min), ["tree_id", "a", "b"])
    c = c.withColumn("_both", F.col("_a") + F.abs("_b")).withColumn("_gap", F.col("_l") - F.col("_both"))
    of = Window.partitionBy("tree_id", "a")
    some = lambda x: F.max(x.cast("int")).over(of) == 1
    first, wide = F.col("_both") > F.col("_l") * 0.8, (F.col("_both") > F.col("_l") * 0.6) | (F.col("_gap") < rcov / 2)
    c = c.withColumn("_n", F.count(F.lit(1)).over(of)).withColumn("_k", F.when(some(first), first | (F.col("_gap") < dmin / 2)).otherwise(wide))
    c = c.withColumn("_kept", F.sum(F.col("_k").cast("int")).over(of)).withColumns({f"_n{k}": F.first(f"_t{k}").over(of.orderBy("_l", "b")) for k in "xyz"})
    opposite = sum((F.col(f"_t{k}") * F.col(f"_n{k}") for k in "yz"), F.col("_tx") * F.col("_nx")) < -0.3
    c = c.withColumn("_o", opposite).withColumn("_none", ~some(F.col("_o") & F.col("_k"))).withColumn("_near", F.row_number().over(Window.partitionBy("tree_id", "a", "_o").orderBy("_l", "b")) == 1)
    added = (F.col("_kept").between(1, 2)) & (F.col("_kept") < F.col("_n")) & F.col("_none") & F.col("_o") & F.col("_near") & (F.col("_gap") < rcov)
    one = c.where((F.col("_n") == 1) | F.col("_k") | added).select("tree_id", "a", "b")
    return one.unionByName(one.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def box_neighbourhood(points: DataFrame, corners: DataFrame, edge: float, n: int) -> DataFrame:
    """``tree_id, box, pid``: points in the cells from ``n`` below to ``n`` above those of each box's two corners (``x0`` .. ``z1``, in any order).

    The cells of the box are listed and joined by equality, so only points of those cells meet.
    """
    cell = lambda c: F.floor(F.col(c) / edge).cast("long")
    span = lambda c: F.explode(F.sequence(F.least(cell(f"{c}0"), cell(f"{c}1")) - n, F.greatest(cell(f"{c}0"), cell(f"{c}1")) + n))
    boxes = corners
    for c in "xyz":
        boxes = boxes.withColumn(f"_c{c}", span(c))
    p = points.select("tree_id", "pid", *[cell(c).alias(f"_c{c}") for c in "xyz"])
    return p.join(boxes, ["tree_id", "_cx", "_cy", "_cz"]).select("tree_id", "box", "pid")


def nearest_between(a: DataFrame, b: DataFrame, edge: float, deeper: int = 8) -> DataFrame:
    """``tree_id, pid_a, pid_b, dist``: the nearest pair between two sets of points of each tree, ties by the numbers. Points without a place and trees with one set alone have no row.

    Pairs of cells are looked at, first those as wide as a tree, then their halves, down to ``edge`` and at most ``deeper`` times beyond. Of these a pair stays if its cells come as near to each other as the
    nearest two points known, one of each cell; what lies in no such pair is dropped before the next round. Pairs of points are made only in what is left when these are
    few beside the points, so sets far from each other cost no more than those that touch.
    """
    at = ["_cx", "_cy", "_cz"]
    place = lambda p, s: p.select("tree_id", "pid", "x", "y", "z").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")).join(s.select("tree_id").distinct(), "tree_id", "left_semi")
    a, b = materialize(place(a, b), "left_points"), materialize(place(b, a), "right_points")
    both = a.unionByName(b).groupBy("tree_id").agg(*[(F.max(c) - F.min(c)).alias(f"_{c}") for c in "xyz"])
    wide = both.agg(F.max(F.greatest("_x", "_y", "_z"))).first()[0]
    side = edge
    while wide is not None and side < wide:
        side *= 2

    def cells(p: DataFrame, n: str) -> DataFrame:
        """Cells with their number of points and the first of these."""
        c = p.withColumns({k: F.floor(F.col(x) / side).cast("long") for k, x in zip(at, "xyz", strict=True)}).groupBy("tree_id", *at)
        c = c.agg(F.count(F.lit(1)).alias(f"n{n}"), F.min(F.struct("pid", "x", "y", "z")).alias(f"p{n}"))
        return c.select("tree_id", *[F.col(k).alias(f"{k}{n}") for k in at], *[F.floor(F.col(k) / 2).cast("long").alias(f"_u{k}{n}") for k in at], f"n{n}", f"p{n}")

    pairs, best, points = None, None, a.count() + b.count()
    while True:
        ca, cb = cells(a, "a"), cells(b, "b")
        if pairs is None:
            c = ca.join(cb, "tree_id")  # at most eight cells of a tree on either side
        else:
            up = lambda n: [F.col(f"{k}{n}").alias(f"_u{k}{n}") for k in at]
            c = pairs.select("tree_id", *up("a"), *up("b")).join(ca, ["tree_id", *[f"_u{k}a" for k in at]]).join(cb, ["tree_id", *[f"_u{k}b" for k in at]])
        gap = [F.greatest(F.abs(F.col(f"{k}a") - F.col(f"{k}b")) - 1, F.lit(0)) * side for k in at]
        apart = [F.col(f"pa.{x}") - F.col(f"pb.{x}") for x in "xyz"]
        size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        c = materialize(c.withColumns({"_least": size(gap), "_known": size(apart)}), "cell_pairs")
        known = c.groupBy("tree_id").agg(F.min("_known").alias("_best"))
        known = known if best is None else known.unionByName(best).groupBy("tree_id").agg(F.min("_best").alias("_best"))
        best = materialize(known, "nearest_known")
        # A point may lie outside its cell by a rounding.
        slack = F.lit(1e-9) * (F.lit(side) + F.col("_best"))
        pairs = materialize(c.join(broadcast_if_small(best), "tree_id").where(F.col("_least") <= F.col("_best") + slack).select("tree_id", *[f"{k}{n}" for n in "ab" for k in at], "na", "nb"), "near_cells")
        within = lambda p, n: p.withColumns({f"{k}{n}": F.floor(F.col(x) / side).cast("long") for k, x in zip(at, "xyz", strict=True)})
        kept = lambda p, n, tag: materialize(within(p, n).join(pairs.select("tree_id", *[f"{k}{n}" for k in at]).distinct(), ["tree_id", *[f"{k}{n}" for k in at]], "left_semi").select("tree_id", "pid", "x", "y", "z"), tag)
        if (pairs.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0) <= 8 * points or side < edge / 2**deeper:
            break
        a, b = kept(a, "a", "left_points"), kept(b, "b", "right_points")
        side /= 2
    left = within(a, "a").withColumnRenamed("pid", "pid_a")
    right = within(b, "b").select("tree_id", F.col("pid").alias("pid_b"), *[F.col(c).alias(f"_{c}") for c in "xyz"], *[f"{k}b" for k in at])
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"), F.lit(0.0)))
    found = pairs.join(left, ["tree_id", *[f"{k}a" for k in at]]).join(right, ["tree_id", *[f"{k}b" for k in at]]).withColumn("dist", d)
    return found.groupBy("tree_id").agg(F.min(F.struct("dist", "pid_a", "pid_b")).alias("_b")).select("tree_id", "_b.pid_a", "_b.pid_b", "_b.dist")


def greedy_density_filter(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Points that some ball of a greedy cover holds with ``least`` points or more, with the size ``n`` of their largest ball.

    The balls are those of a walk in order of ``pid`` that makes a ball of each point no ball holds yet.
    """
    centres, _ = cover(points, radius, radius, 1)
    balls = radius_pairs(points.join(centres, ["tree_id", "pid"], "left_semi"), points, radius)
    size = balls.groupBy("tree_id", "pid_a").agg(F.count(F.lit(1)).alias("_n"))
    most = balls.join(size, ["tree_id", "pid_a"]).groupBy("tree_id", F.col("pid_b").alias("pid")).agg(F.max("_n").alias("n"))
    return most.where(F.col("n") >= least)


def component_filter(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Points of the connected components that have at least ``least`` cover sets of ``radius``."""
    from canopia.operators.components import connected_components

    centres, members = cover(points, radius, 1.5 * radius, 1)
    members = materialize(members, "members")
    near = cover_neighbours(points, members, 1.5 * radius)
    found = connected_components(near.select(F.struct("tree_id", F.col("a").alias("p")).alias("src"), F.struct("tree_id", F.col("b").alias("p")).alias("dst")))
    alone = centres.select(F.struct("tree_id", F.col("pid").alias("p")).alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    large = alone.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    kept = alone.join(large, "component", "left_semi").select("node.tree_id", F.col("node.p").alias("centre"))
    return points.join(members.join(kept, ["tree_id", "centre"], "left_semi"), ["tree_id", "pid"], "left_semi")


def extended_sets(members: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``tree_id, centre, pid``: each cover set with the points of all its neighbours."""
    beside = neighbours.select("tree_id", F.col("a").alias("_set"), F.col("b").alias("centre")).join(members, ["tree_id", "centre"]).select("tree_id", F.col("_set").alias("centre"), "pid")
    return members.select("tree_id", "centre", "pid").unionByName(beside)


def main_directions(points: DataFrame, by: tuple[str, ...] = ("tree_id",), shape: bool = False) -> DataFrame:
    """``by``, ``along_x`` .. and ``across_x`` ..: unit vectors to the largest and the smallest eigenvalue of each cloud's covariance, the largest
    component positive; null where two eigenvalues are equal, and for a single point. With ``shape`` also ``n_points`` and how far the group is a line, a plane or neither (``linear``,
    ``planar``, ``scattered``: steps between the eigenvalues as shares of the first, null where all points are one).

    An eigenvector is the longest cross product of two rows of the shifted matrix. Step by step, so no expression is repeated within another.
    """
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    c = points.groupBy(*by).agg(*[F.covar_samp(p[0], p[1]).alias(p) for p in pairs], F.count(F.lit(1)).alias("n_points"))
    first, middle, last = eigenvalues(*[F.col(p) for p in pairs])
    c = c.withColumns({"_along": first, "_between": middle, "_across": last})
    for name in ("along", "across"):
        rows = [[F.col(p) - F.col(f"_{name}") if p[0] == p[1] else F.col(p) for p in row] for row in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))]
        sides = {f"_s{i}": cross(rows[a], rows[b]) for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))}
        c = c.withColumns({f"{k}{n}": v for k, s in sides.items() for n, v in zip("xyz", s, strict=True)})
        c = c.withColumns({f"_n{i}": dot(v, v) for i in range(3) for v in [[F.col(f"_s{i}{n}") for n in "xyz"]]})
        best = F.greatest("_n0", "_n1", "_n2")
        c = c.withColumns({f"_v{n}": F.when(F.col("_n0") == best, F.col(f"_s0{n}")).when(F.col("_n1") == best, F.col(f"_s1{n}")).otherwise(F.col(f"_s2{n}")) for n in "xyz"})
        c = c.withColumn("_large", F.greatest(*[F.abs(f"_v{n}") for n in "xyz"])).withColumn("_size", norm([F.col(f"_v{n}") for n in "xyz"]))
        sign = F.when(F.abs("_vx") == F.col("_large"), F.signum("_vx")).when(F.abs("_vy") == F.col("_large"), F.signum("_vy")).otherwise(F.signum("_vz"))
        c = c.withColumns({f"{name}_{n}": F.col(f"_v{n}") * sign / F.nullif(F.col("_size"), F.lit(0.0)) for n in "xyz"})
    e1, e2, e3 = (F.col(f"_{k}") / F.nullif(F.col("_along"), F.lit(0.0)) for k in ("along", "between", "across"))
    more = ["n_points", (e1 - e2).alias("linear"), (e2 - e3).alias("planar"), e3.alias("scattered")] if shape else []
    return c.select(*by, *more, *[f"{name}_{n}" for name in ("along", "across") for n in "xyz"])
