"""Interpolation between points as Column expressions; planar, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    """The value at share t of the way from a to b."""
    return a + (b - a) * t


def bezier(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    """One coordinate of a cubic Bezier curve, in Bernstein form."""
    s = F.lit(1.0) - t
    return s * s * s * a + 3.0 * s * s * t * b + 3.0 * s * t * t * c + t * t * t * d


def hermite(p0: Column, p1: Column, p2: Column, p3: Column, t: Column, tension: float) -> Column:
    """One coordinate between p1 and p2 of a cardinal spline: larger tension, shorter tangents."""
    s = (1.0 - tension) / 2.0
    t2, t3 = t * t, t * t * t
    return (2.0 * t3 - 3.0 * t2 + 1.0) * p1 + (3.0 * t2 - 2.0 * t3) * p2 + (t3 - 2.0 * t2 + t) * s * (p2 - p0) + (t3 - t2) * s * (p3 - p1)
