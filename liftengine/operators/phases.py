"""Lift phases: the five border frames of each clip, and the rows between them.

Borders are found one after the other, each from the one before, as minima over the
clip of (value, frame): the first frame wins a tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.plans.span import RunningSum, Total, Whole
from liftengine.schema import require_columns

# fixed values: rows that set the baseline, and the share of the frame height to rise
BASELINE_ROWS = 30
START_SHARE = 0.02
REQUIRED = (
    "barbell_y_stable", "hip_y_avg", "left_knee_y", "right_knee_y", "left_shoulder_y",
    "right_shoulder_y", "frame_height", "time_s",
)
BORDERS = ("t0", "t1", "t2", "t3", "t4")
PHASES = (
    ("first_pull", "t0", "t1"), ("second_pull", "t1", "t2"),
    ("third_pull", "t2", "t3"), ("recovery", "t3", "t4"),
)


def with_baseline(analysis: DataFrame, span=Whole()) -> DataFrame:
    """Mean bar height over the clip's first 30 rows, and the height that starts a lift."""
    bar = F.col("barbell_y_stable")
    placed = span.derive(require_columns(analysis, REQUIRED), _row=RunningSum(F.lit(1)))
    early = F.col("_row") <= BASELINE_ROWS
    # only totals from here on, so long clips are written out just this once
    summed = span.derive(
        span.settle(placed),
        _sum=Total("sum", F.when(early, bar)),
        _count=Total("sum", (early & bar.isNotNull()).cast("bigint")),
        _t4=Total("min", F.when(bar.isNotNull(), F.struct(
            bar.alias("y"), "frame", "time_s"))),
    )
    mean = F.col("_sum") / F.nullif(F.col("_count"), F.lit(0))
    return summed.withColumns({
        "baseline_y": mean,
        "start_y": mean - F.col("frame_height") * F.lit(START_SHARE),
    }).drop("_sum", "_count")


def mark_borders(analysis: DataFrame, span=Whole()) -> DataFrame:
    """The rows of ``analysis`` with the borders as structs ``_t0`` .. ``_t4``, or NULL.

    Pass only the columns that are needed afterwards: long clips are written out per step.
    """
    bar, hip, frame = F.col("barbell_y_stable"), F.col("hip_y_avg"), F.col("frame")

    def first(when, *fields):
        return Total("min", F.when(when, F.struct(*fields)))

    df = with_baseline(analysis, span)
    df = span.derive(df, _t0=first(bar < F.col("start_y"), "frame", "time_s"))
    knees = (F.col("left_knee_y") + F.col("right_knee_y")) / 2 * F.col("frame_height")
    df = span.derive(df, _t1=first(
        (frame >= F.col("_t0")["frame"]) & (bar <= knees), "frame", "_row", "time_s"))
    df = span.derive(df, _top=first(
        (frame >= F.col("_t1")["frame"]) & bar.isNotNull(), bar.alias("y"), "frame"))
    df = span.derive(df, _t2=first(
        frame.between(F.col("_t1")["frame"], F.col("_top")["frame"]) & hip.isNotNull(),
        hip.alias("hip"), "frame", "_row", "time_s"))
    return span.derive(df, _t3=first(
        (frame >= F.col("_t2")["frame"]) & hip.isNotNull(),
        (-hip).alias("height"), "frame", "time_s")).drop("_top")


def identified():
    """Whether a clip has all its borders."""
    return F.col("_t3").isNotNull()


def phases(analysis: DataFrame, span=Whole()) -> DataFrame:
    """One row per clip with frames t0 .. t4; all NULL unless every one is found."""
    needed = require_columns(analysis, REQUIRED).select("clip_id", "frame", *REQUIRED)
    return mark_borders(needed, span).groupBy("clip_id").agg(*[
        F.max(F.when(identified(), F.col(f"_{t}")["frame"])).alias(t) for t in BORDERS])


def phase_slices(analysis: DataFrame, borders: DataFrame, span=Whole()) -> DataFrame:
    """One row per (clip, phase, frame); a border frame lies in both of its phases."""
    placed = span.attach(analysis.select("clip_id", "frame"), borders)
    slices = F.filter(
        F.array(*[
            F.struct(F.lit(name).alias("phase"), F.col(a).alias("a"), F.col(b).alias("b"))
            for name, a, b in PHASES
        ]), lambda p: F.coalesce(F.col("frame").between(p["a"], p["b"]), F.lit(False)))
    return placed.select("clip_id", "frame", F.explode(slices).alias("s")).select(
        "clip_id", "s.phase", "frame")
