"""Column functions on boxes (x, y, w, h; origin bottom left) and polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over the smaller area of boxes held in columns ``<a>_x`` ... ``<b>_h``."""
    c = lambda p, k: F.col(f"{p}_{k}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    high = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    small = F.least(c(a, "w") * c(a, "h"), c(b, "w") * c(b, "h"))
    return F.when((wide > 0) & (high > 0) & (small > 0), wide * high / small).otherwise(F.lit(0.0))


def inside(x: Column, y: Column, box: str, pad: float = 0.0) -> Column:
    """Closed containment of a point in the box of columns ``<box>_x`` ..."""
    c = lambda k: F.col(f"{box}_{k}")
    return (x >= c("x") - pad) & (x <= c("x") + c("w") + pad) & (y >= c("y") - pad) & (y <= c("y") + c("h") + pad)


def span(points: Column, axis: str) -> Column:
    values = F.transform(points, lambda p: p[axis])
    return F.array_max(values) - F.array_min(values)


def is_horizontal(points: Column) -> Column:
    return span(points, "y") < 1.0


def is_vertical(points: Column) -> Column:
    return span(points, "x") < 1.0


def python_round(c: Column) -> Column:
    """Half to even."""
    return F.bround(c)
