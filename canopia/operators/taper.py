"""Radius control: the cylinders of a branch kept between a least and a largest radius that fall along it, and joined end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.functions.vectors import axis_distance, dot, minus, norm, vector

#: Least radius; share of the parent's radius that a branch has at most, and the least of that; limits without a parent; all in metres.
LEAST, OF_PARENT, LEAST_LIMIT, NO_PARENT = 0.0025, 0.95, 0.001, 0.005
#: A trunk's radii are at most so many times their mean. Branches whose radii all stay below ``NO_PARENT`` are thin.
TRUNK_LIMIT = 3
#: Slack of the limiting curve over mean radii, and the least share of the curve, of branches and of trunks. The first radii of a trunk are those up to 2 m.
SLACK, FLOOR, TRUNK_BASE, TRUNK_FLOOR, TRUNK_METRES = 1.05, 0.75, 1.1, 0.7, 2.0
#: A start that moved by more than this (metres, or share of its radius) goes back if the radius was changed as much; shorter steps between cylinders are let be.
MOVED, MOVED_SHARE, STEP = 0.01, 0.5, 0.0001
PLACE, AXIS = ("sx", "sy", "sz"), ("ax", "ay", "az")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column, first: Column, last: Column) -> Column:
    """Mean of the elements from number ``first`` to number ``last`` (from 1)."""
    n = last - first + 1
    return _sum(F.slice(a, first, F.greatest(n, F.lit(0)))) / F.nullif(n, F.lit(0))


def _falling(a: Column, b: Column, t: Column) -> Column:
    """``t`` values from ``a`` down to ``b`` in equal steps."""
    return F.transform(F.sequence(F.lit(0), t - 1), lambda i: a + (b - a) * i / (t - 1))


def _short(r: Column, t: Column) -> Column:
    """Radii of branches of one or two cylinders."""
    most = F.array_max(r)
    return F.when(t == 1, F.array(most)).otherwise(F.array(most, most * 0.5))


def _thin(r: Column, t: Column) -> Column:
    """A thin branch falls from twice the mean of its radii without the least and the largest, or from the largest of those."""
    inner = F.slice(F.array_sort(r), F.lit(2), F.greatest(t - 2, F.lit(0)))
    twice = _sum(inner) / F.nullif(t - 2, F.lit(0)) * 2
    a = F.when(twice > F.array_max(inner), F.least(F.lit(0.01), F.array_max(inner))).otherwise(twice)
    return F.when(t > 2, _falling(a, F.least(F.array_min(r) * 0.5, F.lit(0.001)), t)).otherwise(_short(r, t))


def _few(r: Column, t: Column) -> Column:
    """A branch of three or four cylinders falls from twice the mean of the first two radii, or the largest, to the least radius."""
    twice = F.get(r, F.lit(0)) + F.get(r, F.lit(1))
    return F.when(t > 2, _falling(F.least(twice, F.array_max(r)), F.lit(LEAST), t)).otherwise(_short(r, t))


def _nearest(mid: Column, at: Column) -> Column:
    """The number (from 1) of the middle that is nearest to ``at``; of two the first."""
    gaps = F.transform(mid, lambda m: F.abs(m - at))
    return F.array_position(gaps, F.array_min(gaps)).cast("int")


def _anchors(r: Column, mid: Column, t: Column, total: Column, base: Column, parts: int, inner: int) -> Column:
    """Places and radii that the limiting curve follows: ``base`` at 0, ``inner`` means of successive parts of the branch, and the least radius at the end.

    A part ends at the cylinder whose middle is nearest to the next ``parts``-th of the length. Branches with fewer than ``3 * parts`` or so
    cylinders are cut by numbers of cylinders instead.
    """
    b = F.floor(t / parts + 0.5).cast("int")
    point = lambda x, y: F.struct(x.alias("at"), y.alias("r"))
    by_number = F.transform(F.sequence(F.lit(0), F.lit(inner - 1)), lambda k: point(F.get(mid, F.floor(k * b + 1 + b / 2 + 0.5).cast("int") - 1), _mean(r, k * b + 1, k * b + b) * SLACK))
    ends = F.transform(F.sequence(F.lit(1), F.lit(inner)), lambda k: _nearest(mid, total * k / parts))
    by_length = _let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.lit(inner - 1)), lambda k: point(F.get(mid, F.get(e, k) - 1), _mean(r, F.coalesce(F.get(e, k - 1), F.lit(0)) + 1, F.get(e, k)) * SLACK)))
    return F.concat(F.array(point(F.lit(0.0), base)), F.when(b >= 3, by_length).otherwise(by_number), F.array(point(total, F.lit(LEAST))))


def _under_parabola(r: Column, mid: Column, t: Column, total: Column) -> Column:
    """Radii of a branch between a parabola over its anchors, fitted by normal equations, and three quarters of it."""
    base = _mean(r, F.lit(1), F.greatest(F.ceil(t / 10), F.lit(2)).cast("int")) * SLACK

    def fitted(s: Column) -> Column:
        s = F.filter(s, lambda p: p["at"].isNotNull() & p["r"].isNotNull())
        total_of = lambda f: _sum(F.transform(s, f))
        x4, x2, y2, y0, n = total_of(lambda p: p["at"] ** 4), total_of(lambda p: p["at"] ** 2), total_of(lambda p: p["r"] * p["at"] ** 2), total_of(lambda p: p["r"]), F.size(s)
        det = x4 * n - x2 * x2
        return F.struct(((y2 * n - x2 * y0) / det).alias("a"), ((x4 * y0 - x2 * y2) / det).alias("b"))

    def between(c: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            curve = c["a"] * F.get(mid, i) * F.get(mid, i) + c["b"]
            return F.greatest(F.least(x, curve), curve * FLOOR, F.lit(LEAST))

        return F.transform(r, one)

    return _let(_anchors(r, mid, t, total, base, 4, 3), lambda s: _let(fitted(s), between))


def _under_lines(r: Column, mid: Column, t: Column, total: Column) -> Column:
    """Radii of a trunk between lines from anchor to anchor and seven tenths of them. Anchors of long trunks never rise."""
    far = F.filter(F.transform(mid, lambda m, i: F.when(m >= TRUNK_METRES, i + 1)), lambda i: i.isNotNull())
    base = _mean(r, F.lit(1), F.greatest(F.coalesce(F.get(far, F.lit(0)), t), F.lit(2)).cast("int")) * TRUNK_BASE
    long = F.floor(t / 8 + 0.5) >= 3

    def never_rising(s: Column) -> Column:
        least = lambda k: F.array_min(F.transform(F.slice(s, F.lit(1), k + 1), lambda p: p["r"]))
        return F.when(long, F.transform(s, lambda p, k: F.struct(p["at"].alias("at"), F.when(k == 6, p["r"]).otherwise(least(k)).alias("r")))).otherwise(s)

    def between(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # A cylinder lies on the line that the one before has come to: behind all anchors that its middle has passed.
            before = F.get(mid, i - 1)
            passed = F.least(F.size(F.filter(F.slice(s, F.lit(2), F.lit(5)), lambda p: p["at"] < before)), F.lit(5))
            a, b = F.get(s, passed), F.get(s, passed + 1)
            curve = a["r"] + (F.get(mid, i) - a["at"]) * (b["r"] - a["r"]) / (b["at"] - a["at"])
            return F.when(x > curve, curve).when(x < curve * TRUNK_FLOOR, curve * TRUNK_FLOOR).otherwise(x)

        return F.transform(r, one)

    return _let(_let(_anchors(r, mid, t, total, base, 8, 5), never_rising), between)


def controlled(radii: Column, lengths: Column, limit: Column, trunk: Column) -> Column:
    """The radii of one branch, from its base on, after control; ``limit`` is the radius of the parent cylinder, null without one."""
    most = F.when(limit.isNotNull(), F.greatest(limit * OF_PARENT, F.lit(LEAST_LIMIT))).when(trunk, _sum(radii) / F.size(radii) * TRUNK_LIMIT).otherwise(F.lit(NO_PARENT))
    within = _let(most, lambda m: F.transform(radii, lambda r: F.greatest(F.least(r, m), F.lit(LEAST))))
    middles = F.transform(lengths, lambda x, i: _sum(F.slice(lengths, F.lit(1), i)) + x / 2)

    def chosen(r: Column) -> Column:
        t = F.size(r)
        curve = lambda of: _let(middles, lambda mid: of(r, mid, t, _sum(lengths)))
        return F.when(F.array_max(r) < NO_PARENT, _thin(r, t)).when(t <= 4, _few(r, t)).when(trunk, curve(_under_lines)).otherwise(curve(_under_parabola))

    return _let(within, chosen)


def control_radii(cylinders: DataFrame, limits: DataFrame) -> DataFrame:
    """``cylinders`` with controlled radii, starts that went too far put back, and each start in the plane of the end before it.

    ``limits`` has ``tree_id, branch, parent_radius``. No radius exceeds 0.95 of the parent's (or the least radius, if that is more), and none is
    under the least radius but on thin and very short branches, which fall in equal steps. With columns ``length0, sx0 ... az0`` (as fitted), a cylinder whose
    radius changed by much and whose start left its first axis by much takes those back. A branch is one row while it is worked on: arrays of a
    few numbers for each cylinder. Other columns stay.
    """
    line = Window.partitionBy("tree_id", "branch").orderBy("position")
    keyed = F.struct("position", "radius", "length")
    per_branch = cylinders.groupBy("tree_id", "branch").agg(F.sort_array(F.collect_list(keyed)).alias("_c"), F.min("branch_order").alias("_order"))
    per_branch = per_branch.join(limits, ["tree_id", "branch"], "left")
    column = lambda k: F.transform("_c", lambda x: x[k])
    radii = controlled(column("radius"), column("length"), F.col("parent_radius"), F.col("_order") == 0)
    new = per_branch.select("tree_id", "branch", F.posexplode(F.arrays_zip(F.transform("_c", lambda x: x["position"]).alias("p"), radii.alias("r"))).alias("_i", "_x")).select("tree_id", "branch", F.col("_x.p").alias("position"), F.col("_x.r").alias("_new"))
    c = cylinders.join(new, ["tree_id", "branch", "position"])
    if "sx0" in cylinders.columns:
        changed = F.abs(F.col("_new") - F.col("radius"))
        off, _ = axis_distance(vector(*PLACE), vector(*[f"{k}0" for k in PLACE]), vector(*[f"{k}0" for k in AXIS]))
        far = lambda d: (d > MOVED) | (d > F.col("radius") * MOVED_SHARE)
        back = F.coalesce(far(changed) & far(off), F.lit(False))
        c = c.withColumn("_back", back).withColumns({k: F.when(F.col("_back"), F.col(f"{k}0")).otherwise(F.col(k)) for k in ("length", *PLACE, *AXIS)})
    # The end before stays where it is when its own start moves along its axis, so all starts can move at once; but a cylinder that would
    # become shorter than nothing keeps its length, and its end moves with its start: that is seen in a first look.
    position, axis = vector(*PLACE), vector(*AXIS)

    def step(shift: Column) -> tuple[Column, Column]:
        end = [F.lag(s + a * (F.col("length") - shift)).over(line) for s, a in zip(position, axis, strict=True)]
        gap = minus(position, end)
        return dot(gap, axis), norm(gap) > STEP

    whole = lambda x: (F.col(x) > 0) | (F.col("length") + F.col(x) > 0)
    moved = lambda c, name, by: c.withColumns(dict(zip(("_d", "_far"), step(by), strict=True))).withColumn(name, F.when(F.col("_far"), F.col("_d")).otherwise(0.0))
    c = moved(moved(c, "_first", F.lit(0.0)), "_move", F.when(whole("_first"), 0.0).otherwise(F.col("_first")))
    longer = F.when(whole("_move"), F.col("_move")).otherwise(0.0)
    return c.select(*[
        F.col("_new").alias("radius") if k == "radius" else (F.col("length") + longer).alias("length") if k == "length" else
        (F.col(k) - F.col("_move") * F.col(AXIS[PLACE.index(k)])).alias(k) if k in PLACE else F.col(k) for k in cylinders.columns
    ])
