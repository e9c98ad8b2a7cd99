"""Least-squares cubic smoothing over a sliding window, as column expressions.

A window of ``w`` points is fitted by a cubic; the value at place ``r`` of the window
is a fixed weighting of its points.  In the middle of a clip the point sits in the
middle of its window; near the ends the first or last full window is used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the smoothing
WIDEST = 15
NARROWEST = 5
DEGREE = 3
# the farthest row that a smoothed value can depend on
REACH = WIDEST - 1
WIDTHS = tuple(range(NARROWEST, WIDEST + 1, 2))


def cubic_weights(width: int) -> np.ndarray:
    """Row ``r`` holds the weights that give the fitted value at place ``r``."""
    places = np.arange(width) - width // 2
    powers = np.vander(places / (width // 2), DEGREE + 1, increasing=True)
    return powers @ np.linalg.pinv(powers)


def _weights_literal() -> Column:
    """array over widths of array over places of weights, folded to one literal."""
    def listed(values):
        return "array({})".format(", ".join(values))

    return F.expr(listed(
        listed(listed(f"{float(c)!r}D" for c in row) for row in cubic_weights(width))
        for width in WIDTHS))


def window_width(rows: Column) -> Column:
    """Widest odd window up to 15 that ``rows`` points can fill."""
    odd = rows - F.when(rows % 2 == 0, 1).otherwise(0)
    return F.least(odd, F.lit(WIDEST)).cast("int")


def smooth(value: Column, nearby: Column, position: Column, rows: Column) -> Column:
    """Smoothed value of the row at ``position`` (from 0) among ``rows`` of its clip.

    ``nearby`` is the array of values up to 14 rows before and after it.  Clips too
    short for a window of 5 keep their values.
    """
    width = window_width(rows)
    start = F.greatest(
        F.least(position - F.floor(width / 2), rows - width), F.lit(0)).cast("int")
    array_start = F.greatest(position - REACH, F.lit(0)).cast("int")
    weights = F.element_at(
        F.element_at(_weights_literal(), ((width - NARROWEST) / 2).cast("int") + 1),
        (position - start).cast("int") + 1)
    points = F.slice(nearby, start - array_start + 1, width)
    fitted = F.aggregate(
        F.zip_with(points, weights, lambda v, c: v * c), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(width >= NARROWEST, fitted).otherwise(value)
