"""Vector algebra on columns; a vector is a sequence of three columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def vector(*names: str) -> Vector:
    return [F.col(n) for n in names]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def scaled(a: Vector, k: Column) -> Vector:
    return [x * k for x in a]


def angle_deg(a: Vector, b: Vector) -> Column:
    """Angle between unit vectors in degrees, null if one is; the cosine is clamped, so rounding never leaves its domain."""
    c = dot(a, b)
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))))


def axis_distance(q: Vector, start: Vector, axis: Vector) -> tuple[Column, Column]:
    """Distance of a point from a line, and its height along it."""
    v = minus(q, start)
    h = dot(v, axis)
    return norm(minus(v, scaled(axis, h))), h


def line_distance(p: Vector, d: Vector, q: Vector, e: Vector) -> Column:
    """Distance between two lines given by points and unit directions; parallel ones by the distance of a point."""
    n = cross(d, e)
    size = norm(n)
    return F.when(size > 1e-9, F.abs(dot(minus(q, p), n)) / size).otherwise(axis_distance(q, p, d)[0])


def orthonormal(u: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors at right angles to the unit vector ``u`` and each other, from the axis that ``u`` is least along."""
    a = [F.abs(x) for x in u]
    first = (a[0] <= a[1]) & (a[0] <= a[2])
    second = ~first & (a[1] <= a[2])
    e = [first.cast("double"), second.cast("double"), (~first & ~second).cast("double")]
    v = cross(u, e)
    size = norm(v)
    v = [x / size for x in v]
    return v, cross(u, v)


def rotation_matrix(axis: Vector, angle: Column) -> list[Vector]:
    """Rows of the matrix that turns vectors by ``angle`` about a unit ``axis`` (Rodrigues)."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    k = F.lit(1.0) - c
    return [
        [x * x * k + c, x * y * k - z * s, x * z * k + y * s],
        [y * x * k + z * s, y * y * k + c, y * z * k - x * s],
        [z * x * k - y * s, z * y * k + x * s, z * z * k + c],
    ]


def line_foot(q: Vector, start: Vector, axis: Vector) -> tuple[Column, Vector, Column, Vector]:
    """Distance of a point from a line, the vector at right angles from the line to it, its height along the line, and the foot."""
    v = minus(q, start)
    h = dot(v, axis)
    away = minus(v, scaled(axis, h))
    return norm(away), away, h, [s + a * h for s, a in zip(start, axis, strict=True)]


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, the largest first, by the trigonometric form of the cubic's roots."""
    off = xy * xy + xz * xz + yz * yz
    mean = (xx + yy + zz) / 3
    p = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + off * 2) / 6)
    a, b, c = [F.coalesce((v - mean) / F.nullif(p, F.lit(0.0)), F.lit(0.0)) for v in (xx, yy, zz)]
    d, e, f = [F.coalesce(v / F.nullif(p, F.lit(0.0)), F.lit(0.0)) for v in (xy, xz, yz)]
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    first, last = mean + p * 2 * F.cos(angle), mean + p * 2 * F.cos(angle + 2.0943951023931953)
    return first, mean * 3 - first - last, last
