"""Declared table shapes and the fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------
LANDMARKS = (
    "left_shoulder", "right_shoulder", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
    "left_elbow", "right_elbow", "left_wrist", "right_wrist",
)
# metadata used where a clip does not state its own
DEFAULT_WIDTH, DEFAULT_HEIGHT, DEFAULT_FPS = 1920, 1080, 30.0
# a landmark's position counts above this visibility
VISIBLE_GATE = 0.1
# an ankle counts as a foot above this visibility
FEET_GATE = 0.3
# detections below this confidence are dropped
MIN_CONFIDENCE = 0.25
# a shake estimate needs more tracked features than this
MIN_FLOW_FEATURES = 5
# body edges of the drawn skeleton
SKELETON_EDGES = (
    ("left_shoulder", "right_shoulder"), ("left_shoulder", "left_hip"),
    ("right_shoulder", "right_hip"), ("left_hip", "right_hip"),
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
)
# colour names with their blue-green-red values
COLORS_BGR = {
    "Torso": (255, 255, 0),
    "Left Arm": (0, 165, 255),
    "Right Arm": (0, 255, 255),
    "Left Leg": (255, 0, 128),
    "Right Leg": (0, 255, 0),
    "Barbell Box": (255, 0, 255),
    "White": (255, 255, 255),
}
# bar path colours and labels by phase number modulo 3
PHASE_COLORS = ("red", "orange", "green")
PHASE_LABELS = ("Phase (Up)", "Phase (Down)", "Phase (Up)")
# chart titles by column
CHART_TITLES = {
    "vel_y_smooth": "Smoothed Vertical Velocity (px/s)",
    "accel_y_smooth": "Smoothed Vertical Acceleration (px/s^2)",
    "specific_power_y_smooth": "Smoothed Vertical Specific Power",
}
PATH_CHART_TITLE = "Stabilized Bar Path"
# fault codes with their messages, in report order
FAULTS = {
    "FP_SLOW": "First Pull: You are slowing down in the first pull",
    "FP_KICK": "First Pull: The bar is being kicked out/pulled back too far",
    "SP_HITCH": "Second Pull: You are hitching in the second pull",
    "SP_JUMP": "Second Pull: You are jumping too soon",
    "SP_ARMS": "Second Pull: You are bending your arms too early",
    "TP_STUCK": "Third Pull: You are getting stuck in the transition",
    "RC_TIRING": "Recovery: Your recovery is too tiring",
}
# ------------------------------------------------------------------------------

LANDMARK_POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("vis", T.DoubleType()),
])

CLIPS = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("frame_width", T.LongType()),
    T.StructField("frame_height", T.LongType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("total_frames", T.LongType()),
    T.StructField("lift_type", T.StringType()),
])

FRAMES = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("frame", T.LongType()),
    T.StructField("landmarks", T.MapType(T.StringType(), LANDMARK_POINT)),
    T.StructField("barbell_x_raw", T.DoubleType()),
    T.StructField("barbell_y_raw", T.DoubleType()),
    T.StructField("box_x1", T.DoubleType()),
    T.StructField("box_y1", T.DoubleType()),
    T.StructField("box_x2", T.DoubleType()),
    T.StructField("box_y2", T.DoubleType()),
    T.StructField("shake_dx", T.DoubleType()),
    T.StructField("shake_dy", T.DoubleType()),
])

LANDMARK_ROWS = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("frame", T.LongType()),
    T.StructField("landmark", T.StringType()),
    *LANDMARK_POINT.fields,
])

DETECTIONS = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("frame", T.LongType()),
    T.StructField("det_id", T.LongType()),
    T.StructField("class_id", T.LongType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

FLOW = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("frame", T.LongType()),
    T.StructField("feat_id", T.LongType()),
    T.StructField("dx", T.DoubleType()),
    T.StructField("dy", T.DoubleType()),
    T.StructField("status", T.LongType()),
])

# the analysis table: its key and the 73 columns after it
ANALYSIS_KEY = ("clip_id", "frame")
POSE_FIELDS = tuple(f"{name}_{part}" for name in LANDMARKS for part in ("x", "y", "z", "vis"))
ANALYSIS_TYPES = {
    "frame_width": T.LongType(),
    "frame_height": T.LongType(),
    **{name: T.DoubleType() for name in POSE_FIELDS},
    "lifter_angle_deg": T.DoubleType(),
    "left_knee_angle": T.DoubleType(),
    "right_knee_angle": T.DoubleType(),
    "left_elbow_angle": T.DoubleType(),
    "right_elbow_angle": T.DoubleType(),
    "hip_y_avg": T.DoubleType(),
    "total_shake_x": T.DoubleType(),
    "total_shake_y": T.DoubleType(),
    "barbell_x_raw": T.DoubleType(),
    "barbell_y_raw": T.DoubleType(),
    "barbell_x_stable": T.DoubleType(),
    "barbell_y_stable": T.DoubleType(),
    "time_s": T.DoubleType(),
    "dt": T.DoubleType(),
    "vel_y_px_s": T.DoubleType(),
    "vel_y_smooth": T.DoubleType(),
    "direction_state": T.DoubleType(),
    "phase_change": T.BooleanType(),
    "bar_phase": T.LongType(),
    "accel_y_smooth": T.DoubleType(),
    "specific_power_y_smooth": T.DoubleType(),
    "landmarks_str": T.StringType(),
    "barbell_box_str": T.StringType(),
}
ANALYSIS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ANALYSIS_KEY]
    + [T.StructField(name, kind) for name, kind in ANALYSIS_TYPES.items()]
)


def require_columns(df, names):
    """Raise ``ValueError`` naming every column of ``names`` that ``df`` lacks."""
    have = set(df.columns)
    missing = [name for name in names if name not in have]
    if missing:
        raise ValueError(f"Missing columns {', '.join(missing)}")
    return df


def empty_columns(df, names, key="clip_id"):
    """One row (key, column) for each of ``names`` that has no value in that clip.

    A column that the table lacks has no value in any clip.  One pre-aggregated pass.
    """
    have = set(df.columns)
    counts = df.groupBy(key).agg(*[
        (F.count(name) if name in have else F.lit(0).cast("bigint")).alias(f"_n_{name}")
        for name in names])
    empty = F.filter(F.array(*[
        F.when(F.col(f"_n_{name}") == 0, F.lit(name)) for name in names]),
        lambda name: name.isNotNull())
    return counts.select(key, F.explode(empty).alias("column"))


def with_missing_columns(df, schema):
    """Add each column of ``schema`` that ``df`` lacks, as typed NULL, and cast the rest."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(f):
        if have.get(f.name) == f.dataType:
            return f.name
        source = f.name if f.name in have else "NULL"
        return f"CAST({source} AS {f.dataType.simpleString()}) AS {f.name}"

    return df.selectExpr(*[column(f) for f in schema.fields])
