"""Landmarks and the angles they give: row-local once a frame's landmarks are in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.functions.geometry import (
    joint_angle, lifter_angle, mean_present, to_pixels,
)

PARTS = ("x", "y", "z", "vis")
# which three landmarks span each joint
JOINT_POINTS = {
    "left_knee_angle": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_angle": ("right_hip", "right_knee", "right_ankle"),
    "left_elbow_angle": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_angle": ("right_shoulder", "right_elbow", "right_wrist"),
}


def _raw(name, part):
    return f"_{name}_{part}"


def pack_landmarks(landmarks: DataFrame) -> DataFrame:
    """Landmark rows as one map per frame; a frame holds at most the tracked names."""
    entry = F.struct("landmark", F.struct(*PARTS).alias("point"))
    return (
        landmarks.where(F.col("landmark").isin(*schema.LANDMARKS))
        .groupBy("clip_id", "frame")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("landmarks"))
    )


def landmark_rows(frames: DataFrame) -> DataFrame:
    """The landmark maps of frames as one row per landmark."""
    return frames.select(
        "clip_id", "frame", F.explode("landmarks").alias("landmark", "point"),
    ).select("clip_id", "frame", "landmark", "point.*")


def widen_landmarks(landmarks: DataFrame) -> DataFrame:
    """Landmark rows as one wide row per frame, values as observed (``_left_hip_x`` ...).

    Plain conditional maxima: combined before the shuffle, kept in generated code, and
    only the asked-for columns are computed.
    """
    return landmarks.groupBy("clip_id", "frame").agg(*[
        F.expr(f"max(CASE WHEN landmark = '{name}' THEN {part} END) AS {_raw(name, part)}")
        for name in schema.LANDMARKS for part in PARTS
    ])


def spread_landmarks(frames: DataFrame) -> DataFrame:
    """The same wide columns from the landmark map that the frame carries."""
    return frames.selectExpr("*", *[
        f"landmarks['{name}'].{part} AS {_raw(name, part)}"
        for name in schema.LANDMARKS for part in PARTS
    ])


def unpack_landmarks(wide: DataFrame, gate: float = schema.VISIBLE_GATE) -> DataFrame:
    """The 48 landmark columns: positions only where seen well enough, visibility always."""
    columns = []
    for name in schema.LANDMARKS:
        vis = _raw(name, "vis")
        columns += [
            f"CASE WHEN {vis} > {gate}D THEN {_raw(name, part)} END AS {name}_{part}"
            for part in ("x", "y", "z")
        ]
        columns.append(f"{vis} AS {name}_vis")
    return wide.selectExpr("*", *columns)


def with_lifter_angle(wide: DataFrame) -> DataFrame:
    """Turn of the shoulders, from the observed values whatever their visibility."""
    left, right = "left_shoulder", "right_shoulder"
    return wide.withColumn("lifter_angle_deg", lifter_angle(
        F.col(_raw(left, "x")), F.col(_raw(left, "z")),
        F.col(_raw(right, "x")), F.col(_raw(right, "z"))))


def with_joint_angles(unpacked: DataFrame) -> DataFrame:
    """Knee and elbow angles on pixel positions."""
    def pixel(name):
        return to_pixels(F.col(f"{name}_x"), F.col(f"{name}_y"),
                         F.col("frame_width"), F.col("frame_height"))

    return unpacked.withColumns({
        angle: joint_angle(*[pixel(name) for name in points])
        for angle, points in JOINT_POINTS.items()
    })


def with_hip_height(unpacked: DataFrame) -> DataFrame:
    """Mean height of the hips seen, in pixels from the top."""
    return unpacked.withColumn(
        "hip_y_avg",
        mean_present(F.col("left_hip_y"), F.col("right_hip_y")) * F.col("frame_height"))


def with_pose(wide: DataFrame) -> DataFrame:
    """All pose columns of the analysis table; needs the frame size on each row."""
    return with_hip_height(with_joint_angles(with_lifter_angle(unpack_landmarks(wide))))
