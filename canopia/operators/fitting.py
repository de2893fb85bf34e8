"""Least-squares cylinders through the points of a region, by Gauss-Newton steps; one small fit for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEPS, TOLERANCE = 30, 1e-6


def frame(axis: np.ndarray) -> np.ndarray:
    """Rows of a rotation that takes a unit axis to z."""
    a = np.eye(3)[np.argmin(np.abs(axis))]
    u = np.cross(axis, a)
    u /= np.linalg.norm(u)
    return np.stack([u, np.cross(axis, u), axis])


def fit_cylinder(points: np.ndarray, axis: np.ndarray | None = None) -> dict:
    """``start, axis, radius, length, mean_dist, reliable`` of the cylinder through points.

    Starts from ``axis`` or the direction of greatest spread, and from the mean distance from the line through the mean. Each step
    turns the points so that the axis is z, and solves for the shift and tilt of the line and the radius at once. A fit is
    unreliable if it does not settle, turns far from where it began, or has a radius beyond three times the first.
    """
    centre = points.mean(0)
    spread = points - centre
    if axis is None:
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
    axis = axis / np.linalg.norm(axis)
    first = axis
    radius = first_radius = float(np.linalg.norm(spread - np.outer(spread @ axis, axis), axis=1).mean())
    settled = False
    if len(points) >= 5:
        for _ in range(STEPS):
            turn = frame(axis)
            q = (points - centre) @ turn.T
            d = np.hypot(q[:, 0], q[:, 1])
            n = q[:, :2] / np.maximum(d, 1e-12)[:, None]
            jacobian = np.column_stack([-n[:, 0], -n[:, 1], -q[:, 2] * n[:, 0], -q[:, 2] * n[:, 1], -np.ones(len(q))])
            step, _, rank, _ = np.linalg.lstsq(jacobian, radius - d, rcond=1e-12)
            if rank < 5 or not np.isfinite(step).all():
                break
            tilt = np.array([step[2], step[3], 1.0])
            centre = centre + np.array([step[0], step[1], 0.0]) @ turn
            axis = tilt @ turn / np.linalg.norm(tilt)
            radius += step[4]
            if np.abs(step).max() < TOLERANCE * max(first_radius, 1e-3):
                settled = True
                break
    reliable = settled and abs(first @ axis) > 0.8 and 0 < radius < 3 * first_radius
    if not reliable:
        centre, axis, radius = points.mean(0), first, first_radius
    v = points - centre
    h = v @ axis
    dist = np.abs(np.linalg.norm(v - np.outer(h, axis), axis=1) - radius)
    return {"start": centre + h.min() * axis, "axis": axis, "radius": radius, "length": float(h.max() - h.min()), "mean_dist": float(dist.mean()), "reliable": bool(reliable)}


def fit_cylinders(points: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """One fitted cylinder for each group of at least ``least`` points: a grouped map, as every region is fitted alone and is small."""
    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)

    def one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        if len(b) < least:
            return pd.DataFrame()
        f = fit_cylinder(b[["x", "y", "z"]].to_numpy())
        row = dict(zip(by, key, strict=True)) | {"n_points": len(b), "radius": f["radius"], "length": f["length"], "mean_dist": f["mean_dist"], "reliable": f["reliable"]}
        row |= {f"s{c}": f["start"][i] for i, c in enumerate("xyz")} | {f"a{c}": f["axis"][i] for i, c in enumerate("xyz")}
        return pd.DataFrame([row])[[*by, "n_points", "radius", "length", "sx", "sy", "sz", "ax", "ay", "az", "mean_dist", "reliable"]]

    numbers = ", ".join(f"{c} double" for c in ("radius", "length", "sx", "sy", "sz", "ax", "ay", "az", "mean_dist"))
    return points.select(*by, "x", "y", "z").groupBy(*by).applyInPandas(one, f"{keys}, n_points long, {numbers}, reliable boolean")
