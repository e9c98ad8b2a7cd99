"""Angles, coordinates and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pixels(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Normalised coordinates as pixels; missing stays missing."""
    return x * width, y * height


def to_normalized(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixel coordinates as fractions of the frame; missing stays missing."""
    return x / width, y / height


def truncate(value: Column) -> Column:
    """Whole part, towards zero, as bigint."""
    return value.cast("bigint")


def joint_angle(p1, vertex, p3) -> Column:
    """Degrees at ``vertex`` between two points, each an (x, y) pair of columns.

    NULL when a coordinate is missing or a point coincides with the vertex.
    """
    ax, ay = p1[0] - vertex[0], p1[1] - vertex[1]
    bx, by = p3[0] - vertex[0], p3[1] - vertex[1]
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = (ax * bx + ay * by) / F.nullif(norm, F.lit(0.0))
    # greatest and least pass over NULL, so a missing cosine must stay out of them
    return F.when(
        cosine.isNotNull(),
        F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))),
    )


def lifter_angle(left_x: Column, left_z: Column, right_x: Column, right_z: Column) -> Column:
    """How far the shoulders are turned: 90 degrees when they face the camera squarely."""
    return F.lit(90.0) - F.abs(F.degrees(F.atan2(left_z - right_z, left_x - right_x)))


def mean_present(a: Column, b: Column) -> Column:
    """Mean of those of two values that are present."""
    return F.coalesce((a + b) / 2, a, b)


def body_part(first: str, second: str) -> str:
    """Colour name of the body edge between two landmarks."""
    names = (first, second)
    if all("shoulder" in n or "hip" in n for n in names):
        return "Torso"
    for side in ("left", "right"):
        if all(side in n for n in names):
            upper = any(part in first for part in ("shoulder", "elbow", "wrist"))
            return f"{side.capitalize()} {'Arm' if upper else 'Leg'}"
    return "White"
