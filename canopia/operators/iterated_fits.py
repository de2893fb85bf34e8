"""Circles and cylinders through points by damped Gauss-Newton steps: every step is one aggregation over all groups at once, no group is ever gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.functions.vectors import axis_distance, vector
from canopia.operators.fitting import frame
from canopia.plans.shared import broadcast_if_small, discard, materialize

#: A step is shortened if the squares fall by less than this share of what was foretold, to this share of its length at least.
GAIN, SHORTEST = 0.01, 0.001
#: Steps at most; the relative tolerance and the scale that steps, sums and slopes are held against; the condition from which on a fit is not reliable.
STEPS, TOLERANCE, SCALE, CONDITION = 30, 1e-8, 0.1, 100 * np.finfo(float).eps
#: A second look: mean distance in metres and as a share of the radius, greatest distance as a share of it, and growth of the radius that call for one.
FAR, FAR_SHARE, FARTHEST_SHARE, GROWN = 0.02, 0.1, 0.333, 1.5

Residual = Callable[[DataFrame], DataFrame]
Move = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Progress:
    """Where the fit of one group stands: parameters, the sums at them, the step that is tried, and what came of it."""

    def __init__(self, n: int, state: dict, move: Move) -> None:
        self.n, self.state, self.move = n, dict(state), move

    def _solve(self, sums: np.ndarray) -> None:
        n, s = self.n, self.state
        normal = np.zeros((n, n))
        normal[np.triu_indices(n)] = sums[: n * (n + 1) // 2]
        normal = normal + np.triu(normal, 1).T
        slope, s["f0"] = sums[n * (n + 1) // 2 : -1], float(np.sqrt(max(sums[-1], 0.0)))
        size = np.sqrt(np.maximum(np.diag(normal), 0.0))
        if s["scale"] is None:
            s["scale"] = size.tolist()
        # The condition of the triangular factor is the root of that of the normal matrix.
        good = np.isfinite(normal).all() and (size > 0).all()
        values = np.linalg.eigvalsh(normal) if good else np.zeros(n)
        if not good or values[0] <= values[-1] * CONDITION**2 or np.sqrt(max(values[0], 0.0) / values[-1]) < CONDITION:
            s["done"], s["reliable"] = True, False
            return
        step = -np.linalg.solve(normal, slope)
        s["step"], s["slope"], s["foretold"] = step.tolist(), (2 * slope).tolist(), float(2 * slope @ step)
        s["trial"], s["tested"] = self.move(np.array(s["at"]), step).tolist(), True

    def after(self, sums: np.ndarray) -> dict:
        """The state once the squares and slopes at ``trial`` are known."""
        s = self.state
        s["steps"] += 1
        if not s["tested"]:
            s["at"] = s["trial"]
            self._solve(sums)
            return s
        f1 = float(np.sqrt(max(sums[-1], 0.0)))
        scale, eps = np.maximum(np.array(s["scale"]), 1e-300), np.finfo(float).eps ** 0.7 * SCALE
        moved, steep = np.abs(np.array(s["step"]) * scale).max(), np.abs(np.array(s["slope"]) / scale).max()
        small = TOLERANCE**0.7 * SCALE
        if moved < small and abs(s["f0"] - f1) < TOLERANCE * SCALE and steep < small or f1 < eps or steep < eps:
            s["at"], s["done"], s["settled"] = s["trial"], True, True
        elif s["steps"] >= STEPS:
            s["done"] = True
        else:
            gain = (f1 - s["f0"]) * (f1 + s["f0"]) / s["foretold"] if s["foretold"] else 0.0
            if gain < GAIN:
                s["trial"], s["tested"] = self.move(np.array(s["at"]), max(SHORTEST, 1 / (2 * (1 - gain))) * np.array(s["step"])).tolist(), False
            else:
                s["at"] = s["trial"]
                self._solve(sums)
        return s


_STATE = "at array<double>, trial array<double>, step array<double>, slope array<double>, scale array<double>, f0 double, foretold double, steps int, tested boolean, done boolean, settled boolean, reliable boolean"


def fit(points: DataFrame, starts: DataFrame, by: list[str], n: int, residual: Residual, move: Move) -> DataFrame:
    """``by``, ``at`` (parameters), ``settled`` and ``reliable`` of the least squares of each group of ``points`` from ``starts`` (``by``, ``at``).

    ``residual`` adds to points with their parameters ``_at`` the residual ``_f`` and its ``n`` derivatives ``_d0`` ..; ``move`` gives the parameters after a step. In
    each round the points of the groups still open meet their parameters, sums of products are added up by group, and one small state a group is
    moved on: to a full step, a shortened one where the squares did not fall as foretold, or to its end. A group is unreliable where the
    normal equations have no sure solution, and not settled after ``STEPS`` evaluations.
    """
    null = lambda kind: F.lit(None).cast(kind)
    no = F.lit(False)
    state = starts.select(*by, "at", F.col("at").alias("trial"), *[null("array<double>").alias(c) for c in ("step", "slope", "scale")], F.lit(0.0).alias("f0"), F.lit(0.0).alias("foretold"), F.lit(0).alias("steps"), no.alias("tested"), no.alias("done"), no.alias("settled"), F.lit(True).alias("reliable"))
    state = materialize(state, "fit_state")
    names = [c.split()[0] for c in _STATE.split(", ")]

    @F.pandas_udf(_STATE)
    def moved(sums: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        rows = []
        for k, s in enumerate(sums):
            state = {c: v.iloc[k] for c, v in zip(names, columns, strict=True)}
            rows.append(Progress(n, state, move).after(np.asarray(s, float)))
        return pd.DataFrame(rows, columns=names)

    for _ in range(2 * STEPS + 1):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        near = points.join(broadcast_if_small(open_.select(*by, F.col("trial").alias("_at"))), by)
        near = residual(near)
        of = [F.col(f"_d{i}") for i in range(n)]
        sums = near.groupBy(*by).agg(F.array(*[F.sum(of[i] * of[j]) for i in range(n) for j in range(i, n)], *[F.sum(d * F.col("_f")) for d in of], F.sum(F.col("_f") * F.col("_f"))).alias("_s"))
        stepped = open_.join(sums, by).withColumn("_n", moved("_s", *names)).select(*by, *[F.col(f"_n.{c}").alias(c) for c in names])
        after = materialize(state.where("done").unionByName(stepped), "fit_state")
        discard(state)
        state = after
    return state.select(*by, "at", F.col("settled").alias("settled"), "reliable")


def fit_circles(points: DataFrame, by: list[str], starts: DataFrame | None = None) -> DataFrame:
    """``by``, ``xc, yc, radius``, ``mean_dist`` (of the points from the circle), ``settled, reliable`` of the circle through each group's ``x, y``.

    ``starts`` has ``by`` and ``at`` (centre and radius); unset, the mean place and the mean distance from it. Groups of less than three points have none.
    """
    p = points.select(*by, "x", "y")
    if starts is None:
        m = p.groupBy(*by).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
        off = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
        starts = p.join(m, by).groupBy(*by).agg(F.array(F.first("_x"), F.first("_y"), F.avg(off)).alias("at"))
    starts = materialize(starts, "fit_starts")

    def residual(near: DataFrame) -> DataFrame:
        at = F.col("_at")
        near = near.withColumns({"_x": F.col("x") - at[0], "_y": F.col("y") - at[1]}).withColumn("_r", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
        away = F.nullif("_r", F.lit(0.0))  # a point in the middle pulls nowhere
        return near.withColumns({"_f": F.col("_r") - at[2], "_d0": -F.coalesce(F.col("_x") / away, F.lit(0.0)), "_d1": -F.coalesce(F.col("_y") / away, F.lit(0.0)), "_d2": F.lit(-1.0)})

    found = materialize(fit(p, starts, by, 3, residual, lambda a, step: a + step), "circles")
    far = residual(p.join(broadcast_if_small(found.select(*by, F.col("at").alias("_at"))), by)).groupBy(*by).agg(F.avg(F.abs("_f")).alias("mean_dist"))
    return found.join(far, by).select(*by, *[F.col("at")[i].alias(c) for i, c in enumerate(("xc", "yc", "radius"))], "mean_dist", "settled", "reliable")


def _framed(a: np.ndarray) -> np.ndarray:
    """A cylinder (place, axis, radius) with two directions at right angles to its axis."""
    return np.concatenate([a[:7], frame(a[3:6])[:2].ravel()])


def _tilted(a: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A cylinder after a shift and tilt in the frame of its axis."""
    turn = np.vstack([a[7:10], a[10:13], a[3:6]])
    axis = np.array([step[2], step[3], 1.0]) @ turn
    return _framed(np.concatenate([a[:3] + np.array([step[0], step[1], 0.0]) @ turn, axis / np.linalg.norm(axis), [a[6] + step[4]]]))


def _cylinder_residual(near: DataFrame) -> DataFrame:
    """Distance of a point from the side, and how it changes with a shift and a tilt of the axis and with the radius."""
    at = F.col("_at")
    near = near.withColumns({f"_v{c}": F.col(c) - at[i] for i, c in enumerate("xyz")})
    along = lambda k: F.col("_vx") * at[k] + F.col("_vy") * at[k + 1] + F.col("_vz") * at[k + 2]
    near = near.withColumns({"_u": along(7), "_w": along(10), "_h": along(3)}).withColumn("_r", F.sqrt(F.col("_u") * F.col("_u") + F.col("_w") * F.col("_w")))
    away = F.nullif("_r", F.lit(0.0))
    near = near.withColumns({"_f": F.col("_r") - at[6], "_d0": -F.coalesce(F.col("_u") / away, F.lit(0.0)), "_d1": -F.coalesce(F.col("_w") / away, F.lit(0.0)), "_d4": F.lit(-1.0)})
    return near.withColumns({"_d2": F.col("_h") * F.col("_d0"), "_d3": F.col("_h") * F.col("_d1")})


def cylinder_starts(points: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """``by``, ``at``: the mean place, the direction of greatest spread and the mean distance from that line, from sums alone."""
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    m = points.groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"], F.array(*[F.covar_pop(p[0], p[1]) for p in pairs]).alias("_c"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)

    @F.pandas_udf("array<double>")
    def direction(c: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.eigh(np.array([[v[0], v[1], v[2]], [v[1], v[3], v[4]], [v[2], v[4], v[5]]]))[1][:, 2] for v in c])

    m = materialize(m.select(*by, "_x", "_y", "_z", direction("_c").alias("_a")), "directions")
    off, _ = axis_distance(vector("x", "y", "z"), vector("_x", "_y", "_z"), [F.col("_a")[i] for i in range(3)])
    return points.join(broadcast_if_small(m), by).groupBy(*by).agg(F.array(F.first("_x"), F.first("_y"), F.first("_z"), *[F.first(F.col("_a")[i]) for i in range(3)], F.avg(off)).alias("at"))


def fit_cylinders(points: DataFrame, by: list[str], starts: DataFrame | None = None, least: int = 5) -> DataFrame:
    """As :func:`canopia.operators.fitting.fit_cylinders`, with a second look: ``by, n_points, radius, length, sx .. az, mean_dist, reliable, refitted``.

    A fit counts if it settled, its mean distance is below the first radius, its axis is near the first (cosine over 0.8) and its radius under three times the first. If then
    the points lie far off and the radius has grown, it is made again from there with the nearer points: those within half of the greatest distance, within a quarter if these are
    fewer than ten or a quarter of all, else all. Where no fit counts the start stands.
    """
    p = materialize(points.select(*by, "x", "y", "z"), "fit_points")
    framed = F.pandas_udf(lambda a: pd.Series([_framed(np.asarray(x, float)) for x in a]), "array<double>")
    starts = cylinder_starts(p, by, least) if starts is None else starts
    starts = materialize(starts.select(*by, framed("at").alias("at")), "fit_starts")
    first = starts.select(*by, F.col("at").alias("_first"))
    at = lambda i: F.col("at")[i]

    def judged(points: DataFrame, starts: DataFrame) -> DataFrame:
        f = materialize(fit(points, starts, by, 5, _cylinder_residual, _tilted).join(first, by), "cylinders")
        near = _cylinder_residual(points.join(broadcast_if_small(f.select(*by, F.col("at").alias("_at"))), by))
        s = near.groupBy(*by).agg(F.avg(F.abs("_f")).alias("_mad"), F.max(F.abs("_f")).alias("_md"), F.count(F.lit(1)).alias("_n"))
        r, r0 = at(6), F.col("_first")[6]
        turn = F.abs(at(3) * F.col("_first")[3] + at(4) * F.col("_first")[4] + at(5) * F.col("_first")[5])
        counts = F.col("settled") & F.col("reliable") & (F.col("_mad") < r0) & (turn > 0.8) & (r > 0) & (r < r0 * 3) & ~F.isnan(r)
        again = counts & (F.col("_mad") > FAR) & (F.col("_mad") / r > FAR_SHARE) & (F.col("_md") / r > FARTHEST_SHARE) & (r > r0 * GROWN)
        return materialize(f.join(s, by).withColumn("counts", F.coalesce(counts, F.lit(False))).withColumn("again", F.coalesce(again, F.lit(False))), "judged")

    found, seen = judged(p, starts).withColumn("refitted", F.lit(False)), p
    more = found.where("again")
    if not more.isEmpty():
        near = _cylinder_residual(p.join(broadcast_if_small(more.select(*by, F.col("at").alias("_at"), "_md", "_n")), by)).select(*by, "x", "y", "z", F.abs("_f").alias("_d"), "_md", "_n")
        within = [F.sum((F.col("_d") < F.col("_md") * k).cast("int")) for k in (0.5, 0.25)]
        few = lambda k: (F.col(k) < 10) | (F.col(k) < F.col("_all") * 0.25)
        bound = near.groupBy(*by).agg(within[0].alias("_half"), within[1].alias("_quarter"), F.first("_n").alias("_all")).select(*by, F.when(~few("_half"), 0.5).when(~few("_quarter"), 0.25).alias("_k"))
        chosen = materialize(near.join(broadcast_if_small(materialize(bound, "bounds")), by).where(F.col("_k").isNull() | (F.col("_d") < F.col("_md") * F.col("_k"))).select(*by, "x", "y", "z"), "nearer")
        second = judged(chosen, more.select(*by, "at")).withColumn("refitted", F.lit(True))
        found = found.where(~F.col("again")).unionByName(second)
        seen = p.join(broadcast_if_small(more.select(*by)), by, "left_anti").unionByName(chosen)
    found = materialize(found.select(*by, "counts", "refitted", F.when(F.col("counts"), F.col("at")).otherwise(F.col("_first")).alias("at")), "found")
    near = _cylinder_residual(seen.join(broadcast_if_small(found.select(*by, F.col("at").alias("_at"))), by))
    span = near.groupBy(*by).agg(F.min("_h").alias("_h0"), F.max("_h").alias("_h1"), F.avg(F.abs("_f")).alias("mean_dist"), F.count(F.lit(1)).alias("n_points"))
    return found.join(span, by).select(
        *by, "n_points", at(6).alias("radius"), (F.col("_h1") - F.col("_h0")).alias("length"), *[(at(i) + at(i + 3) * F.col("_h0")).alias(f"s{c}") for i, c in enumerate("xyz")],
        *[at(i + 3).alias(f"a{c}") for i, c in enumerate("xyz")], "mean_dist", F.col("counts").alias("reliable"), "refitted",
    )
