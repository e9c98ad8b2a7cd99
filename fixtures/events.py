"""Clip tables derived from a plain ``events`` table (see FIXTURES.md).

Every user is a clip, the order of a user's events numbers its frames, and integer
arithmetic on the event gives bar, joints, detections and flow.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftengine.plans.span import (
    BLOCK, ROWS_PER_TASK, Blocks, RunningSum, Whole, longest_group, span_for,
)
from liftengine.sources.scratch import scratch_path, write_scratch
from liftengine.sources.tracks import Tracks

# joint number, name, and resting position in thousandths of the frame
JOINTS = (
    (0, "left_shoulder", 550, 400), (1, "right_shoulder", 450, 400),
    (2, "left_hip", 540, 560), (3, "right_hip", 460, 560),
    (4, "left_knee", 540, 740), (5, "right_knee", 460, 740),
    (6, "left_ankle", 540, 900), (7, "right_ankle", 460, 900),
    (8, "left_elbow", 550, 500), (9, "right_elbow", 450, 500),
    (10, "left_wrist", 550, 600), (11, "right_wrist", 450, 600),
)
# candidate number, x offset, modulus of the y offset
CANDIDATES = ((0, 0, 1), (1, 260, 40), (2, -40, 9))
EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")
# class names of the imagined detector
CLASS_NAMES = {0: "endcap", 1: "plate"}


def _rows(tuples, *names):
    """SQL array of named structs, to be inlined next to each row."""
    def cell(value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    structs = ", ".join(
        "named_struct({})".format(", ".join(f"'{n}', {cell(v)}" for n, v in zip(names, row)))
        for row in tuples)
    return f"inline(array({structs}))"


def _slice_of(width: int):
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / F.lit(width))


def slice_seconds(events: DataFrame, longest: int, rows_per_task: int) -> int:
    """Length of time slices that no user fills beyond ``rows_per_task``.

    Starts from an even spread and halves the slices while a burst still overfills one;
    each look is a pre-aggregated count.
    """
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, int((hi - lo).total_seconds()) // -(-longest // rows_per_task))
    while width > 1 and longest_group(
            events.select("user_id", _slice_of(width).alias("slice")),
            "user_id", "slice") > rows_per_task:
        width //= 2
    return width


def numbered(events: DataFrame, longest: int, rows_per_task: int) -> DataFrame:
    """Events with ``frame``: their position among the user's events by time.

    Users with very many events are cut by time; each slice is numbered on its own.
    """
    key, order = "user_id", ("ts", "event_id")
    if longest <= rows_per_task:
        span = Whole(key, order)
    else:
        width = slice_seconds(events, longest, rows_per_task)
        span = Blocks(rows_per_task, key, order, block=_slice_of(width))
    placed = span.derive(events, _n=RunningSum(F.lit(1)))
    return placed.withColumn("frame", F.col("_n").cast("bigint") - 1).drop("_n", BLOCK)


def base(events: DataFrame, longest: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per kept event with the integers that everything else comes from."""
    placed = numbered(
        events.select("user_id", "ts", "event_id", "event_type", "value", "props"),
        longest, rows_per_task)
    drawn = placed.select(
        F.col("user_id").alias("clip_id"), "frame", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    ).where("NOT (event_type = 'error' AND k % 4 = 0)")
    return drawn.selectExpr(
        "clip_id", "frame", "event_type", "v", "k",
        "(v*31 + k*17 + frame*7) % 1000 AS n", "36 + clip_id % 9 AS f1",
        "greatest(frame - 20, 0) AS r")


def clips(rows: DataFrame) -> DataFrame:
    return rows.groupBy("clip_id").agg(F.max("frame").alias("m")).selectExpr(
        "clip_id",
        "CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(1920 AS BIGINT) END AS frame_width",
        "CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(1080 AS BIGINT) END AS frame_height",
        "CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(30 AS DOUBLE) END AS fps",
        "m + 13 AS total_frames",
        "CASE WHEN clip_id % 10 = 9 THEN 'none' WHEN clip_id % 10 = 8 THEN 'snatch'"
        " ELSE 'clean' END AS lift_type")


_BAR_X = """CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN NULL ELSE CAST(8000
  + (CASE WHEN clip_id % 2 = 0 THEN least(r, 15)*80 ELSE 0 END) + (n % 7)*10 AS DOUBLE)/10e0 END"""
_BAR_Y = """CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN NULL ELSE CAST(9180
  - (CASE WHEN clip_id % 5 = 1 THEN 140*least(r, 40) - r*r ELSE 60*r + r*r END)
  + (CASE WHEN clip_id % 4 = 0 AND frame BETWEEN f1+12 AND f1+20 THEN (frame-f1-11)*300 ELSE 0 END)
  + (n % 5)*10 AS DOUBLE)/10e0 END"""


def frames(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "clip_id", "frame", f"{_BAR_X} AS barbell_x_raw", f"{_BAR_Y} AS barbell_y_raw",
        "CAST((n % 9) - 4 AS DOUBLE)/4e0 AS shake_dx",
        "CAST((n % 5) - 2 AS DOUBLE)/4e0 AS shake_dy")


def landmarks(rows: DataFrame) -> DataFrame:
    joints = rows.selectExpr(
        "clip_id", "frame", "n", "f1", "r", _rows(JOINTS, "j", "landmark", "x0", "y0"))
    return joints.selectExpr(
        "clip_id", "frame", "landmark",
        """CAST(x0 + (n + j*13) % 4 + (CASE WHEN landmark LIKE '%elbow' AND clip_id % 3 = 0
           AND r >= 12 THEN 25 ELSE 0 END) AS DOUBLE)/1000e0 AS x""",
        """CAST(y0 + (n + j*29) % 4 + (CASE WHEN landmark LIKE '%hip' THEN -2*least(frame, f1)
           + (CASE WHEN clip_id % 7 < 4 THEN 30 ELSE 7 END)*least(greatest(frame-f1, 0), 10)
           - least(6*greatest(frame-f1-10, 0), (CASE WHEN clip_id % 7 < 4 THEN 290 ELSE 60 END))
           ELSE 0 END) AS DOUBLE)/1000e0 AS y""",
        "CAST((n + j*7) % 200 - 100 AS DOUBLE)/1000e0 AS z",
        "CAST((n*13 + j*31) % 100 AS DOUBLE)/100e0 AS vis")


def detections(rows: DataFrame) -> DataFrame:
    bar = rows.selectExpr(
        "clip_id", "frame", "v", "n", f"{_BAR_X} AS bar_x", f"{_BAR_Y} AS bar_y",
    ).where("bar_y IS NOT NULL")
    placed = bar.selectExpr("*", _rows(CANDIDATES, "det", "off_x", "mod_y")).selectExpr(
        "clip_id", "frame", "CAST(det AS BIGINT) AS det_id",
        "CAST(CASE WHEN det = 2 THEN 1 ELSE 0 END AS BIGINT) AS class_id",
        "CASE WHEN det = 2 THEN 'plate' ELSE 'endcap' END AS class_name",
        "CAST((v + det*37) % 100 AS DOUBLE)/100e0 AS conf",
        "bar_x + (CASE WHEN det = 1 AND n % 11 = 0 THEN 1100 ELSE off_x END) AS cx",
        "bar_y + (v % mod_y) AS cy")
    return placed.selectExpr(
        "clip_id", "frame", "det_id", "class_id", "class_name", "conf",
        "cx - 30.25e0 AS x1", "cy - 30.25e0 AS y1", "cx + 30.75e0 AS x2", "cy + 30.75e0 AS y2")


def flow(rows: DataFrame) -> DataFrame:
    features = rows.where("frame > 0").selectExpr(
        "clip_id", "frame", "n", _rows([(i,) for i in range(8)], "feat"))
    return features.selectExpr(
        "clip_id", "frame", "CAST(feat AS BIGINT) AS feat_id",
        "CAST((n + feat*3) % 9 - 4 AS DOUBLE)/4e0 AS dx",
        "CAST((n + feat*5) % 5 - 2 AS DOUBLE)/4e0 AS dy",
        "CAST(CASE WHEN (n + feat*feat) % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS status")


class EventTables:
    """The clip tables over one ``events`` file, each set up when first asked for.

    The events are numbered once, and a row per clip is made from them once; both go to the
    scratch folder.  Every table reads those files anew: they are then independent relations,
    which Spark joins without renaming one side's plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK):
        self._spark, self._path = spark, f"{sf_dir}/events.parquet"
        self._rows_per_task = rows_per_task
        self._longest = longest_group(self._events(), "user_id")
        self.span = span_for(self._longest, rows_per_task)

    def _events(self):
        return self._spark.read.schema(EVENTS).parquet(self._path)

    @cached_property
    def _numbered(self):
        rows = base(self._events(), self._longest, self._rows_per_task)
        path = scratch_path(self._spark, "events")
        rows.write.parquet(path)
        return rows.schema, path

    def _base(self):
        shape, path = self._numbered
        return self._spark.read.schema(shape).parquet(path)

    @cached_property
    def clips(self):
        return write_scratch(clips(self._base()), "clips")

    @cached_property
    def frames(self):
        return frames(self._base())

    @cached_property
    def landmarks(self):
        return landmarks(self._base())

    @cached_property
    def detections(self):
        return detections(self._base())

    @cached_property
    def flow(self):
        return flow(self._base())

    def tracks(self) -> Tracks:
        return Tracks(
            clips=self.clips, frames=self.frames, landmarks=self.landmarks,
            detections=self.detections, flow=self.flow, span=self.span)


class RoughTables(EventTables):
    """The same clips as a careless recording gives them, by their number modulo 7.

    1: the ankles rise; 2: the bar stays down; 3: no frame rate; 4: a frame comes twice;
    5: no frames; 6: no bar at all, and of the odd ones no more than the first two frames.
    """

    @cached_property
    def clips(self):
        return super().clips.withColumn("fps", F.expr(
            "CASE WHEN clip_id % 7 = 3 THEN 0D ELSE fps END"))

    def _kept(self, rows):
        return rows.where("clip_id % 7 <> 5 AND (clip_id % 14 <> 13 OR frame < 2)")

    @cached_property
    def frames(self):
        rows = self._kept(super().frames).withColumns({
            "barbell_x_raw": F.expr("CASE WHEN clip_id % 7 <> 6 THEN barbell_x_raw END"),
            "barbell_y_raw": F.expr("""CASE WHEN clip_id % 7 = 6 THEN NULL
                WHEN clip_id % 7 = 2 AND barbell_y_raw IS NOT NULL THEN 918D
                ELSE barbell_y_raw END""")})
        times = "CASE WHEN clip_id % 7 = 4 AND frame = 10 THEN array(1, 2) ELSE array(1) END"
        return rows.select("*", F.explode(F.expr(times)).alias("_time")).drop("_time")

    @cached_property
    def landmarks(self):
        return self._kept(super().landmarks).withColumn("y", F.expr("""
            CASE WHEN clip_id % 7 = 1 AND landmark LIKE '%ankle'
            THEN y - 4 * least(greatest(frame - 24, 0), 20) / 1000D ELSE y END"""))

    def tracks(self) -> Tracks:
        return Tracks(clips=self.clips, frames=self.frames, landmarks=self.landmarks,
                      span=self.span)


def tracks_from_events(
    spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK,
) -> Tracks:
    """All clip tables over ``events``; the longest clip decides the span."""
    return EventTables(spark, sf_dir, rows_per_task).tracks()
