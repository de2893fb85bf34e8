"""Rounding of result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column | str, digits: int = 4) -> Column:
    """Rounded half away from zero, with zero never negative."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def half_even(x: Column, digits: int) -> Column:
    """Rounded half to even, as the tables of the inventory are."""
    return F.bround(x, digits) + F.lit(0.0)


def by_magnitude(x: Column) -> Column:
    """Fewer decimals for larger numbers: none over 100, one over 10, two over 1, else three. What is rounded half away from zero is the number times the power of ten, so 11.45 gives 11.4."""
    a, whole = F.abs(x), lambda k: F.round(x * F.lit(float(k)), 0) / k + F.lit(0.0)
    return F.when(a > 100, whole(1)).when(a > 10, whole(10)).when(a > 1, whole(100)).otherwise(whole(1000))


def axis_end(x: Column, step: float, up: bool = True) -> Column:
    """The end of a plot's axis: what is over the last multiple of ``step`` is added once more, or taken away."""
    over = F.pmod(x, F.lit(step))
    return x + over if up else x - over


def metres(x: Column, extent: Column, factor: float = 1000.0) -> Column:
    """Coordinates in metres: a cloud higher than ``factor`` is taken to be in thousandths."""
    return F.when(extent > factor, x / factor).otherwise(x)
