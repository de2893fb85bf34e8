"""Cylinder regions: every segment is cut along its layers into pieces about as long as a multiple of their radius."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.functions.vectors import axis_distance, minus, norm, vector
from canopia.operators import iterated_fits
from canopia.plans.shared import broadcast_if_small, discard, materialize

#: Points that the first region of a segment, and each further one, must have before it is closed; points of a segment that is looked at at all.
FIRST_POINTS, POINTS, SEGMENT_POINTS = 30, 20, 20
#: Points count as a region's up to this multiple of the median distance from its axis; for the first look at a stem the smaller one.
WIDE, NARROW = 3.0, 1.5
#: Distances are told apart in steps of so many metres, which bounds the histogram from which a median is read.
STEP = 1e-4

SEGMENT = ["tree_id", "segment"]
START = [*SEGMENT, "i0"]
_B, _T, _V = [tuple(f"{n}{c}" for c in "xyz") for n in "btv"]


def mended_bases(sets: DataFrame) -> DataFrame:
    """``sets`` (``tree_id, segment, centre, layer, x, y, z``) with ``layer`` counted from 1 in each segment, and the first four taken as one where the first is at neither end.

    Ends are those of the first five layers' centres along their direction of greatest spread; segments of up to four layers stay as they are.
    """
    dense = sets.select(*SEGMENT, "layer").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("layer")).cast("long"))
    s = materialize(sets.join(dense, [*SEGMENT, "layer"]).withColumn("layer", F.col("_k")).drop("_k"), "segment_sets")
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    head = s.where("layer <= 5")

    @F.pandas_udf("array<double>")
    def direction(c: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.eigh(np.array([[v[0], v[1], v[2]], [v[1], v[3], v[4]], [v[2], v[4], v[5]]]))[1][:, 2] for v in c])

    spread = head.groupBy(*SEGMENT).agg(F.max("layer").alias("_n"), F.array(*[F.covar_pop(p[0], p[1]) for p in pairs]).alias("_c")).where("_n = 5")
    spread = materialize(spread.select(*SEGMENT, direction("_c").alias("_a")), "directions")
    along = sum(F.col(c) * F.col("_a")[i] for i, c in enumerate("xyz"))
    base = F.when(F.col("layer") == 1, F.col("_p"))
    ends = head.join(broadcast_if_small(spread), SEGMENT).withColumn("_p", F.round(along, 9)).groupBy(*SEGMENT).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.min(base).alias("_blo"), F.max(base).alias("_bhi"))
    turned = materialize(ends.where("_lo <> _blo AND _hi <> _bhi").select(*SEGMENT, F.lit(True).alias("_turned")), "turned")
    out = s.join(broadcast_if_small(turned), SEGMENT, "left").withColumn("layer", F.when(F.col("_turned"), F.greatest(F.col("layer") - 3, F.lit(1).cast("long"))).otherwise(F.col("layer")))
    return out.drop("_turned")


def _axis() -> list[Column]:
    """Direction from B to T; straight up where they are one place."""
    v = minus(vector(*_T), vector(*_B))
    size = norm(v)
    return [F.when(size > 0, c / size).otherwise(F.lit(up)) for c, up in zip(v, (0.0, 0.0, 1.0), strict=True)]


def _distances(points: DataFrame, trials: DataFrame) -> DataFrame:
    """Points of the layers ``i0`` to ``i1`` of each trial with ``_q``, steps from its axis, and ``_h``, height along it (rounded, as the end may be a point itself)."""
    each = trials.withColumns(dict(zip(("vx", "vy", "vz"), _axis(), strict=True))).withColumn("ht", F.round(norm(minus(vector(*_T), vector(*_B))), 9)).withColumn("layer", F.explode(F.sequence("i0", "i1")))
    near = points.join(broadcast_if_small(materialize(each, "trial_layers")), [*SEGMENT, "layer"])
    d, h = axis_distance(vector("x", "y", "z"), vector(*_B), vector(*_V))
    return near.withColumn("_q", F.round(d / STEP).cast("long")).withColumn("_h", F.round(h, 9))


def _inside() -> Column:
    """Whether a point lies between the ends of a trial: no lower end for the first region, no upper one for the last."""
    return (F.col("first") | (F.col("_h") >= 0)) & (F.col("open") | (F.col("_h") <= F.col("ht")))


def _close(q: str, r: str) -> Column:
    return (F.col(q) < F.col("factor") * F.col(r)) | (F.col(q) == 0)


def _measured(points: DataFrame, trials: DataFrame) -> DataFrame:
    """Trials with ``r0`` and ``r`` (median steps from the axis before and after far points are left out), ``n`` (points inside), ``top`` and ``low`` (greatest height of those, least of all) and ``upward``.

    Trials with fewer than three points between their ends take all above the lower one (``upward``). One pass over the points makes a histogram of distances for each
    trial, both medians are read from that.
    """
    near = _distances(points, trials)
    between, above = _inside(), F.col("_h") >= 0
    counted = lambda c: F.sum(c.cast("long"))
    h = near.groupBy(*START, "_q").agg(
        counted(between).alias("_n1"), counted(above).alias("_n2"), F.max(F.when(between, F.col("_h"))).alias("_t1"), F.max(F.when(above, F.col("_h"))).alias("_t2"),
        F.min("_h").alias("_low"), F.first("first").alias("first"), F.first("factor").alias("factor"),
    )
    h = materialize(h, "distances")
    few = h.groupBy(*START).agg(F.sum("_n1").alias("_all"))
    h = h.join(broadcast_if_small(materialize(few, "between")), START).withColumn("upward", ~F.col("first") & (F.col("_all") < 3))
    h = h.withColumns({"_n": F.when(F.col("upward"), F.col("_n2")).otherwise(F.col("_n1")), "_t": F.when(F.col("upward"), F.col("_t2")).otherwise(F.col("_t1"))})
    mean = F.sum(F.col("_q") * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))
    first = h.groupBy(*START).agg(F.percentile("_q", F.lit(0.5), F.col("_n")).alias("_median"), mean.alias("_mean"), F.min("_low").alias("low"), F.first("upward").alias("upward"))
    first = materialize(first.select(*START, "low", "upward", F.when(F.col("_median") > 0, F.col("_median")).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("r0")), "medians")
    kept = h.drop("upward").join(broadcast_if_small(first), START).where((F.col("_n") > 0) & _close("_q", "r0"))
    second = kept.groupBy(*START).agg(F.percentile("_q", F.lit(0.5), F.col("_n")).alias("r"), F.sum("_n").alias("n"), F.max("_t").alias("top"))
    zero = {"n": 0, "r": 0.0, "top": 0.0}
    return trials.join(first, START, "left").join(second, START, "left").fillna({**zero, "r0": 0.0, "low": 0.0, "upward": False})


_STATE = [*START, "i", "i1", "k", "nl", "turn", "bx", "by", "bz", "tx", "ty", "tz", "first", "open", "factor", "r0", "r", "n", "top", "low", "upward"]


def _grown(points: DataFrame, places: DataFrame, state: DataFrame, length: float) -> DataFrame:
    """Trials carried on layer by layer until each is long and full enough or its segment ends; all open ones at once.

    ``state`` holds measured trials; ``i`` is the layer that the next upper end would be in, ``k`` how many layers a further region has, ``turn`` how many it may have.
    """
    state = materialize(state.select(*_STATE), "region_trials")
    at = places.select(*SEGMENT, F.col("layer").alias("i"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    while True:
        size = F.when(F.col("first"), F.col("top") - F.col("low")).otherwise(norm(minus(vector(*_T), vector(*_B))))
        short = size < length * F.col("r") * STEP
        more = F.when(F.col("first"), short | (F.col("n") < FIRST_POINTS)).otherwise(short & (F.col("k") <= F.col("turn")) | (F.col("n") < POINTS))
        going = (F.col("i") <= F.col("nl") - 1) & more
        open_ = state.where(going)
        if open_.isEmpty():
            return state
        trial = open_.join(at, [*SEGMENT, "i"]).drop("tx", "ty", "tz", "factor", "i1", "r0", "r", "n", "top", "low", "upward")
        trial = trial.withColumns({f"t{c}": F.col(f"_{c}") for c in "xyz"} | {"factor": F.lit(WIDE), "i": F.col("i") + 1, "k": F.col("k") + 1}).withColumn("i1", F.col("i")).drop("_x", "_y", "_z")
        after = materialize(state.where(~going).select(*_STATE).unionByName(_measured(points, materialize(trial, "trials")).select(*_STATE)), "region_trials")
        discard(state)
        state = after


def _half(n: str) -> Column:
    return F.ceil(F.col(n) / 2).cast("long")


def _reached(jumps: DataFrame, begin: DataFrame) -> DataFrame:
    """``tree_id, segment, i0, step``: where one comes from ``begin`` by ``to`` of ``jumps``, by doubling: as many rounds as the number of steps has binary digits."""
    jumps, reached, far = materialize(jumps, "jumps"), materialize(begin.withColumn("step", F.lit(0).cast("long")), "reached"), 1
    while True:
        more = materialize(reached.join(jumps, START).select(*SEGMENT, F.col("to").alias("i0"), (F.col("step") + far).alias("step")), "reached")
        if more.isEmpty():
            return reached
        reached = materialize(reached.unionByName(more), "reached")
        on = jumps.select(*SEGMENT, F.col("i0").alias("to"), F.col("to").alias("_to"))
        jumps, far = materialize(jumps.join(on, [*SEGMENT, "to"]).select(*START, F.col("_to").alias("to")), "jumps"), far * 2


def regions(points: DataFrame, members: DataFrame, sets: DataFrame, length: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Regions of every segment: (``tree_id, segment, region, pid``) and (``tree_id, segment, region, n_points, sx .. sz, ax .. az, length, radius``).

    ``sets`` (``tree_id, centre, layer, segment, parent_segment``) as :func:`canopia.operators.segmentation.segments` gives them. The first region begins with four layers and takes on one
    after another until it is ``length`` radii long and has 30 points; the number of layers it ends with, NL, is what a further one may have. That begins where
    the one before ended, with half of NL, and takes on layers until it is long enough or has NL, and has 20 points. A radius is the median distance from the line between the mean places
    of the end layers, points beyond three medians left out. A further region takes no point of the first; with fewer than 20 points it counts to the one before. Layers after the last
    upper end that leave no room for half a region belong to none. Regions but the last are as long as the way to the next start. Segments of two or three layers are one region without the first layer; those of one layer,
    of at most two sets, or with at most 20 points have none.

    How far a region goes depends on where it begins, so the cut from *every* layer is made at once, each in as many rounds as it takes on layers, and those that follow from the first one are found by doubling: no segment is walked region by
    region, no segment or region is gathered. All points of a layer count, at any size; a point in the bend between two regions may be in both. Empty tables give empty tables; nulls in places belong to no region.
    """
    p = points.select("tree_id", "pid", "x", "y", "z").dropna()
    own = sets.select("tree_id", "segment", "parent_segment", "centre", "layer").dropDuplicates(["tree_id", "centre"])
    s = materialize(mended_bases(own.join(p.withColumnRenamed("pid", "centre"), ["tree_id", "centre"])), "mended_sets")
    q = p.join(members.select("tree_id", "pid", "centre"), ["tree_id", "pid"]).join(s.select("tree_id", "centre", "segment", "parent_segment", "layer"), ["tree_id", "centre"])
    q = materialize(q.select(*SEGMENT, "layer", "pid", "x", "y", "z", F.col("parent_segment").isNull().alias("stem"), (F.col("pid") == F.col("centre")).alias("is_centre")), "segment_points")
    base = F.sum((F.col("layer") == 1).cast("long"))
    sizes = q.groupBy(*SEGMENT).agg(F.max("layer").alias("nl"), F.count(F.lit(1)).alias("_n"), base.alias("_base"), F.sum(F.col("is_centre").cast("long")).alias("_sets"), F.first("stem").alias("stem"))
    sizes = materialize(sizes.where((F.col("nl") > 1) & (F.col("_n") > SEGMENT_POINTS) & (F.col("_n") > F.col("_base")) & (F.col("_sets") > 2)).select(*SEGMENT, "nl", "stem"), "segment_sizes")
    centre = lambda c: F.avg(F.when(F.col("is_centre"), F.col(c)))
    sums = materialize(q.groupBy(*SEGMENT, "layer").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in "xyz"], *[centre(c).alias(f"c{c}") for c in "xyz"]), "layer_places")

    def start(lo: int, hi: int, name: str) -> DataFrame:
        """Mean place of the points in some layers of each segment."""
        part = sums.where(F.col("layer").between(lo, hi)).groupBy(*SEGMENT)
        return part.agg(*[(F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(f"{name}{c}") for c in "xyz"])

    one = F.lit(1).cast("long")
    flags = {"first": F.lit(True), "open": F.lit(False), "turn": one, "k": one}
    seed = sizes.where("nl > 3").join(start(1, 2, "b"), SEGMENT).join(start(3, 4, "t"), SEGMENT).withColumns(flags | {"i0": one, "i": one + 3, "i1": one + 3, "factor": F.when(F.col("stem"), NARROW).otherwise(WIDE)})
    first = materialize(_grown(q, sums, _measured(q, materialize(seed.drop("stem"), "trials")), length).withColumn("taken", F.greatest(F.col("i") - 1, one + 2)), "first_regions")

    # The cut from every layer, and the second region's, which begins a layer before its lower end (as i0 = 1 - NL, below all others).
    nl = first.select(*SEGMENT, "nl", F.col("taken").alias("turn"))
    each = sums.join(nl, SEGMENT).select(*SEGMENT, F.col("layer").alias("i0"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), "nl", "turn", F.col("layer").alias("_from"), F.lit(False).alias("second")).where("i0 >= turn - 1")
    second = first.select(*SEGMENT, (F.col("taken") - 1).alias("i0"), F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("tz").alias("bz"), "nl", F.col("taken").alias("turn"), F.col("taken").alias("_from"), F.lit(True).alias("second"))

    def cut(begins: DataFrame) -> DataFrame:
        t = begins.withColumn("i", F.col("_from") + _half("turn")).where("i <= nl - 1")
        upper = sums.select(*SEGMENT, F.col("layer").alias("i"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
        t = t.join(upper, [*SEGMENT, "i"]).withColumns({"first": F.lit(False), "open": F.lit(False), "factor": F.lit(WIDE), "k": _half("turn") + 1, "i": F.col("i") + 1}).withColumn("i1", F.col("i"))
        return _grown(q, sums, _measured(q, materialize(t.drop("_from", "second"), "trials")), length)

    begun, others = cut(second), materialize(cut(each), "cuts")
    ended = F.col("i") >= F.col("nl") - 1
    nexts = others.where(~ended & (F.col("i") - 1 + _half("turn") <= F.col("nl") - 1)).select(*START, (F.col("i") - 1).alias("to"))
    begun = materialize(begun, "second_regions")
    further = begun.where(~ended & (F.col("i") - 1 + _half("turn") <= F.col("nl") - 1)).select(*SEGMENT, (F.col("i") - 1).alias("i0"))
    walk = others.join(_reached(nexts, further), START).withColumn("step", F.col("step") + 2)
    walk = materialize(begun.withColumn("step", one).unionByName(walk), "walk")
    last = _measured(q, materialize(walk.where(ended).drop("r0", "r", "n", "top", "low", "upward").withColumns({"open": F.lit(True), "i1": F.col("nl")}), "trials"))
    walk = materialize(walk.where(~ended).unionByName(last.select(*walk.columns)).unionByName(first.withColumn("step", one - 1).select(*walk.columns)), "walk")

    # Points of each step; those of the first are taken, steps with few new ones count to the step before.
    near = _distances(q, walk)
    inside = F.when(F.col("upward"), F.col("_h") >= 0).otherwise(_inside()) & _close("_q", "r0")
    taken = materialize(near.where(inside).select(*SEGMENT, "step", "pid"), "step_points")
    gone = taken.where("step = 0").select(*SEGMENT, "pid")
    new = materialize(taken.where("step = 0").unionByName(taken.where("step > 0").join(gone, [*SEGMENT, "pid"], "left_anti")), "new_points")
    counts = walk.select(*SEGMENT, "step").join(new.groupBy(*SEGMENT, "step").agg(F.count(F.lit(1)).alias("_new")), [*SEGMENT, "step"], "left")
    counts = counts.withColumn("begins", (F.col("step") == 0) | (F.coalesce("_new", F.lit(0)) >= POINTS))
    order = Window.partitionBy(*SEGMENT).orderBy("step")
    numbered = materialize(counts.select(*SEGMENT, "step", "begins", F.sum(F.col("begins").cast("long")).over(order).alias("region")), "numbered")
    long_points = new.join(numbered.select(*SEGMENT, "step", "region"), [*SEGMENT, "step"]).select(*SEGMENT, "region", "pid").distinct()
    v = _axis()
    begins = walk.join(numbered.where("begins"), [*SEGMENT, "step"])
    shift = F.when(F.col("step") == 0, F.col("low")).otherwise(F.lit(0.0))
    size = F.when(F.col("step") == 0, F.col("top") - F.col("low")).when(F.col("open"), F.col("top")).otherwise(norm(minus(vector(*_T), vector(*_B))))
    shape = begins.select(*SEGMENT, "region", *[(F.col(f"b{c}") + shift * v[i]).alias(f"s{c}") for i, c in enumerate("xyz")], *[v[i].alias(f"a{c}") for i, c in enumerate("xyz")], size.alias("length"), (F.col("r") * STEP).alias("radius"))
    along = Window.partitionBy(*SEGMENT).orderBy("region")
    shape = shape.withColumns({f"_n{c}": F.lead(f"s{c}").over(along) - F.col(f"s{c}") for c in "xyz"})
    way = norm(vector("_nx", "_ny", "_nz"))
    shape = shape.withColumn("_way", way).withColumns({f"a{c}": F.when(F.col("_way") > 0, F.col(f"_n{c}") / F.col("_way")).otherwise(F.col(f"a{c}")) for c in "xyz"} | {"length": F.coalesce("_way", "length")}).drop("_nx", "_ny", "_nz", "_way")

    # Segments of two or three layers.
    few = sizes.where("nl <= 3").select(*SEGMENT, "nl")
    ends = sums.join(few, SEGMENT).groupBy(*SEGMENT).agg(*[F.max(F.when(F.col("layer") == at, F.col(f"c{c}"))).alias(f"{n}{c}") for n, at in (("b", one), ("t", F.col("nl"))) for c in "xyz"])
    body = q.where("layer > 1").join(broadcast_if_small(materialize(few, "short_segments")), SEGMENT)
    middle = body.groupBy(*SEGMENT).agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"])
    line = materialize(ends.select(*SEGMENT, *[a.alias(f"v{c}") for c, a in zip("xyz", v, strict=True)]).join(middle, SEGMENT), "short_axes")
    d, h = axis_distance(vector("x", "y", "z"), vector("_mx", "_my", "_mz"), vector(*_V))
    spans = body.join(broadcast_if_small(line), SEGMENT).withColumns({"_q": F.round(d / STEP).cast("long"), "_h": h})
    spans = spans.groupBy(*SEGMENT).agg(F.percentile("_q", 0.5).alias("_r"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    short = line.join(spans, SEGMENT).select(*SEGMENT, one.alias("region"), *[(F.col(f"_m{c}") + F.col("_lo") * F.col(f"v{c}")).alias(f"s{c}") for c in "xyz"], *[F.col(f"v{c}").alias(f"a{c}") for c in "xyz"], (F.col("_hi") - F.col("_lo")).alias("length"), (F.col("_r") * STEP).alias("radius"))
    out = materialize(long_points.unionByName(body.select(*SEGMENT, one.alias("region"), "pid")), "region_points")
    count = out.groupBy(*SEGMENT, "region").agg(F.count(F.lit(1)).alias("n_points"))
    return out, shape.unionByName(short).join(count, [*SEGMENT, "region"]).select(*SEGMENT, "region", "n_points", "sx", "sy", "sz", "ax", "ay", "az", "length", "radius")


def region_cylinders(points: DataFrame, region_points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Cylinders of the regions by damped steps from their first shapes, as :func:`canopia.operators.iterated_fits.fit_cylinders` gives them."""
    by = [*SEGMENT, "region"]
    starts = shapes.where("radius > 0").select(*by, F.array("sx", "sy", "sz", "ax", "ay", "az", "radius").alias("at"))
    return iterated_fits.fit_cylinders(points.join(region_points, ["tree_id", "pid"]).select(*by, "x", "y", "z"), by, starts)
