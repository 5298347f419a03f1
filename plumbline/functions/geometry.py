"""Distances, orders and grid cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: str = "q", b: str = "") -> Column:
    """Exact integer squared distance of columns ax, ay, az and bx, by, bz."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0))


#: Neighbours come by distance, then coordinates, then ordinal.
NEIGHBOUR_ORDER = ("d2", "x", "y", "z", "idx")


def cell(c: str | Column, size: float) -> Column:
    """Ordinal of the cell along one axis: the coordinate times the inverse size, rounded down."""
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("double") * F.lit(1.0 / size)).cast("long")


def cells(size: float, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}c{c}": cell(f"{prefix}{c}", size) for c in "xyz"}


def shell_bound(size: float, radius: int, prefix: str = "q") -> Column:
    """Distance from a point to the nearest face of the cube of cells within the radius, a little less for rounding."""
    faces = []
    for c in "xyz":
        at, own = F.col(f"{prefix}{c}"), F.col(f"{prefix}c{c}")
        faces += [at - (own - radius) * F.lit(size), (own + radius + 1) * F.lit(size) - at]
    return F.greatest(F.lit(0.0), F.least(*faces) * (1 - 1e-12) - 1e-6)


def threshold(base: int, ratio: tuple[int, int]) -> int:
    """base times the ratio, rounded up; 0 for a ratio without numerator, base for one without denominator."""
    num, den = ratio
    if num <= 0:
        return 0
    return base if den <= 0 else (base * num + den - 1) // den
