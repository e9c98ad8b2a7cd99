"""Bar position, velocity, acceleration and movement phases along each clip.

The functions are steps of one chain.  Columns with a leading underscore are helpers
that later steps use; `liftengine.schema.ANALYSIS` says what is kept in the end.
Row number, previous frame and previous height do not change when the tail of a clip
is cut off, so they are taken together with the first pass over the clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.functions.smoothing import REACH, smooth
from liftengine.plans.span import (
    LastKnown, Nearby, NextKnown, Previous, RunningSum, Total, Whole,
)

# fixed values: slowest movement that counts, and its share of the clip's fastest
MIN_SPEED_PX_S = 10.0
SPEED_SHARE = 0.05


def frame_gaps(frames: DataFrame, span=Whole()) -> DataFrame:
    """Per clip, how many times frame numbers jump by more than one."""
    seen = span.derive(frames.select("clip_id", "frame"), _prev_frame=Previous(F.col("frame")))
    return seen.groupBy("clip_id").agg(
        F.count_if(F.col("frame") - F.col("_prev_frame") > 1).alias("frame_gaps"))


def unpack_center(frames: DataFrame) -> DataFrame:
    """``barbell_center`` struct as raw x and y; NULL columns where there is none."""
    if "barbell_center" not in frames.columns:
        return frames.withColumns({
            "barbell_x_raw": F.lit(None).cast("double"),
            "barbell_y_raw": F.lit(None).cast("double"),
        })
    return frames.withColumns({
        "barbell_x_raw": F.col("barbell_center.x").cast("double"),
        "barbell_y_raw": F.col("barbell_center.y").cast("double"),
    })


def cumulative_shake(frames: DataFrame, span=Whole()) -> DataFrame:
    """Camera shake added up since the clip's first frame, with the row helpers."""
    return span.derive(
        frames,
        total_shake_x=RunningSum(F.col("shake_dx")),
        total_shake_y=RunningSum(F.col("shake_dy")),
        _row=RunningSum(F.lit(1)),
        _prev_frame=Previous(F.col("frame")),
        _first_frame=Total("min", F.col("frame")),
    )


def stabilize(df: DataFrame) -> DataFrame:
    """Bar position with the shake taken out."""
    return df.withColumns({
        "barbell_x_stable": F.col("barbell_x_raw") - F.col("total_shake_x"),
        "barbell_y_stable": F.col("barbell_y_raw") - F.col("total_shake_y"),
    })


def truncate_at_peak(df: DataFrame, span=Whole()) -> DataFrame:
    """Keep frames up to the first at which the bar is highest; all, if it is never seen."""
    height = F.col("barbell_y_stable")
    found = span.derive(
        df,
        _peak=Total("min", F.when(height.isNotNull(), F.struct(height.alias("y"), "frame"))),
        _prev_y=Previous(height),
    )
    peak = F.col("_peak")["frame"]
    return found.where(peak.isNull() | (F.col("frame") <= peak)).drop("_peak")


def time_axis(df: DataFrame) -> DataFrame:
    """Seconds since the clip's first frame, and since the row before."""
    def seconds(frame):
        return (frame - F.col("_first_frame")) / F.col("fps")

    now = seconds(F.col("frame"))
    return df.withColumns({
        "time_s": now,
        "dt": F.coalesce(now - seconds(F.col("_prev_frame")), 1 / F.col("fps")),
    })


def velocity(df: DataFrame) -> DataFrame:
    """Vertical speed in pixels per second, up positive."""
    rise = F.col("barbell_y_stable") - F.col("_prev_y")
    return df.withColumn("vel_y_px_s", -(rise / F.col("dt")))


def interpolate_linear(df: DataFrame, source: str, target: str, span=Whole()) -> DataFrame:
    """Fill gaps of ``source`` by row position.

    Inner gaps are filled on a straight line, a gap at the end holds the last value and
    one at the start is 0.  Also notes the clip's number of rows in ``_rows``.
    """
    value, row = F.col(source), F.col("_row")
    known = F.when(value.isNotNull(), F.struct(row.alias("p"), value.alias("v")))
    around = span.derive(
        df, _left=LastKnown(known), _right=NextKnown(known), _rows=Total("max", row))
    left, right = F.col("_left"), F.col("_right")
    slope = (right["v"] - left["v"]) / (right["p"] - left["p"])
    line = left["v"] + (row - left["p"]) * slope
    return around.withColumn(
        target, F.coalesce(value, line, left["v"], F.lit(0.0))).drop("_left", "_right")


def savgol(df: DataFrame, source: str, target: str, span=Whole()) -> DataFrame:
    """Smooth ``source`` (which has no gaps) by a cubic over up to 15 rows."""
    around = span.derive(df, _nearby=Nearby(F.col(source), REACH))
    smoothed = smooth(F.col(source), F.col("_nearby"), F.col("_row") - 1, F.col("_rows"))
    return around.withColumn(target, smoothed).drop("_nearby")


def acceleration(df: DataFrame, span=Whole()) -> DataFrame:
    """Change of the smoothed speed, power per mass, and the clip's speed threshold."""
    speed = F.col("vel_y_smooth")
    seen = span.derive(
        df, _prev_v=Previous(speed), _top_speed=Total("max", F.abs(speed)))
    accel = (speed - F.col("_prev_v")) / F.col("dt")
    return seen.withColumns({
        "vel_threshold": F.greatest(
            F.lit(MIN_SPEED_PX_S), F.col("_top_speed") * F.lit(SPEED_SHARE)),
        "accel_y_smooth": accel,
        "specific_power_y_smooth": accel * speed,
    }).drop("_prev_v", "_top_speed")


def direction(df: DataFrame, span=Whole()) -> DataFrame:
    """1 going up, -1 going down; slow rows keep the state before, 1 at the start."""
    speed, threshold = F.col("vel_y_smooth"), F.col("vel_threshold")
    clear = F.when(speed > threshold, 1.0).when(speed < -threshold, -1.0)
    seen = span.derive(
        df, _state=LastKnown(clear), _state_before=LastKnown(clear, inclusive=False))
    state = F.coalesce("_state", F.lit(1.0))
    before = F.when(F.col("_row") > 1, F.coalesce("_state_before", F.lit(1.0)))
    return seen.withColumns({
        "direction_state": state,
        "phase_change": ~state.eqNullSafe(before),
    }).drop("_state", "_state_before")


def bar_phase(df: DataFrame, span=Whole()) -> DataFrame:
    """Number of the movement phase, from 1."""
    return span.derive(df, bar_phase=RunningSum(F.col("phase_change").cast("bigint")))


def stable_track(frames: DataFrame, span=Whole()) -> DataFrame:
    """Frames up to the peak with the stabilised bar; needs ``fps`` on each row."""
    return truncate_at_peak(stabilize(cumulative_shake(frames, span)), span)


def smoothed_track(frames: DataFrame, span=Whole()) -> DataFrame:
    """`stable_track` with time axis, velocity and smoothed velocity."""
    moving = velocity(time_axis(stable_track(frames, span)))
    filled = interpolate_linear(moving, "vel_y_px_s", "vel_filled", span)
    return savgol(filled, "vel_filled", "vel_y_smooth", span)


def kinematics(frames: DataFrame, span=Whole()) -> DataFrame:
    """The whole chain: everything the analysis table says about the bar."""
    return bar_phase(direction(acceleration(smoothed_track(frames, span), span), span), span)


def detection_rate(track: DataFrame) -> DataFrame:
    """Per clip, tracked and all frames up to the peak, and their ratio in percent."""
    counts = track.groupBy("clip_id").agg(
        F.count("barbell_y_stable").alias("tracked_frames"),
        F.count(F.lit(1)).alias("total_frames"),
    )
    return counts.withColumn("detection_rate", rate_percent(
        F.col("tracked_frames"), F.col("total_frames")))


def rate_percent(detected, total):
    """``detected`` of ``total`` in percent, 0 when there are none."""
    return F.when(total == 0, 0.0).otherwise(detected * 100.0 / total)
