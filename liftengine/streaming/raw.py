"""Following the bar on streams of raw detections, landmarks and flow vectors.

The streams carry ``at``, the time of the frame that a row belongs to; all rows of a frame
have the same.  They are brought to one layout and grouped by frame in a single keyed
aggregation, in place of a join per stream: one exchange and one state store.  A frame is
complete, and leaves that state, once the watermark has passed it.  The watermark follows
the slowest of the streams, less ``delay``.  So frames reach the tracker behind it in order
of time from batch to batch, and the tracker takes each batch in order of frames.

Rows that come later than ``delay`` are dropped by Spark, which counts them.  A row with
NULL ``clip_id`` belongs to no frame and only moves the watermark, as a source does that has
nothing to report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.functions.geometry import mean_present, to_pixels
from liftengine.operators.detection import clamp_boxes, is_wanted
from liftengine.streaming.tracker import _tracked

DELAY = "10 seconds"
_OPTION = "struct<det_id:bigint,cx:bigint,cy:bigint>"
_ANKLE = "struct<side:string,x:double,y:double>"
_FEATURE = "struct<dx:double,dy:double>"


def _laid_out(rows: DataFrame, delay: str, **own: Column) -> DataFrame:
    """Rows of one stream in the layout of all of them, with its watermark."""
    kinds = {"frame_width": "bigint", "option": _OPTION, "ankle": _ANKLE, "feature": _FEATURE}
    return rows.withWatermark("at", delay).select("clip_id", "frame", "at", *[
        own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def complete_frames(
    frames: DataFrame, detections: DataFrame, landmarks: DataFrame, flow: DataFrame,
    clips: DataFrame, class_name: str = "endcap", names: dict[int, str] | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """One row per frame with its candidates, feet and shake, once nothing more can come.

    ``clips`` is a table and has its defaults.
    """
    sizes = clips.select("clip_id", "frame_width", "frame_height")
    idle = F.col("clip_id").isNull()
    boxes = clamp_boxes(detections.where(idle | is_wanted(class_name, names=names)), clips)
    ankles = landmarks.where(idle | (
        F.col("landmark").isin("left_ankle", "right_ankle") & (F.col("vis") > schema.FEET_GATE))
    ).join(sizes, "clip_id", "left")
    x, y = to_pixels(F.col("x"), F.col("y"), F.col("frame_width"), F.col("frame_height"))
    dx, dy = (F.when(F.col("status") == 1, F.col(c)).alias(c) for c in ("dx", "dy"))
    streams = [
        _laid_out(frames.join(sizes, "clip_id", "left"), delay,
                  frame_width=F.coalesce("frame_width", F.lit(schema.DEFAULT_WIDTH))),
        _laid_out(boxes, delay, option=F.struct("det_id", "cx", "cy")),
        _laid_out(ankles, delay, ankle=F.struct(
            F.col("landmark").alias("side"), x.alias("x"), y.alias("y"))),
        _laid_out(flow, delay, feature=F.struct(dx, dy)),
    ]

    def foot(side: str, part: str) -> Column:
        return F.max(F.when(F.col("ankle.side") == f"{side}_ankle", F.col(f"ankle.{part}")))

    return reduce(DataFrame.unionByName, streams).groupBy("clip_id", "frame", "at").agg(
        F.max("frame_width").alias("frame_width"),
        F.sort_array(F.collect_list("option")).alias("options"),
        *[foot(side, part).alias(f"{side}_{part}")
          for side in ("left", "right") for part in ("x", "y")],
        F.count("feature.dx").alias("features"),
        F.median("feature.dx").alias("mx"), F.median("feature.dy").alias("my"),
    ).where(F.col("frame_width").isNotNull())


def _keyed(found: DataFrame) -> DataFrame:
    """Complete frames in the tracker's layout."""
    feet_x = mean_present(F.col("left_x"), F.col("right_x"))
    feet_y = mean_present(F.col("left_y"), F.col("right_y"))
    placed = found.withColumns({"feet_x": feet_x, "feet_y": feet_y})

    def first_key(option: Column) -> Column:
        near_feet = ((option["cx"] - F.col("feet_x")) * (option["cx"] - F.col("feet_x"))
                     + (option["cy"] - F.col("feet_y")) * (option["cy"] - F.col("feet_y")))
        return F.coalesce(near_feet, F.abs(option["cx"] - F.col("frame_width") / 2))

    enough = F.col("features") > schema.MIN_FLOW_FEATURES
    return placed.select(
        "clip_id", "frame", F.col("frame").alias("seq"),
        F.coalesce(F.when(enough, F.col("mx")), F.lit(0.0)).alias("shake_dx"),
        F.coalesce(F.when(enough, F.col("my")), F.lit(0.0)).alias("shake_dy"),
        F.col("options.det_id").alias("det_ids"),
        F.transform("options", first_key).alias("first_keys"),
        F.col("options.cx").alias("cxs"), F.col("options.cy").alias("cys"),
        F.col("at").alias("arrived"))


def track_raw_stream(*streams: DataFrame, **how) -> DataFrame:
    """Chosen bar and running shake from the raw streams (arguments of `complete_frames`)."""
    return _tracked(_keyed(complete_frames(*streams, **how)), numbered=False)
