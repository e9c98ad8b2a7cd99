
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle
from fixtures.events import CLASS_NAMES, EventTables, RoughTables
from liftengine import schema
from liftengine.functions.geometry import to_normalized, to_pixels, truncate
from liftengine.functions.text import (
    box_to_text, landmarks_to_text, text_to_box, text_to_landmarks,
)
from liftengine.operators import (
    charts, detection, faults, kinematics, overlay, phases, pose, report,
)
from liftengine.plans import fleet, incremental
from liftengine.plans.span import ROWS_PER_TASK
from liftengine.sources import clustered, sinks
from liftengine.sources.counts import Counts
from liftengine.sources.scratch import scratch_path, write_scratch
from liftengine.sources.tracks import (
    clip_defaults, clip_problems, read_tracks, validate_tracks, with_clip_metadata,
)
from liftengine.streaming.raw import track_raw_stream
from liftengine.streaming.tracker import frame_stream, run_available

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline
    from liftengine.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

KEY = ("clip_id", "frame")
POSE = [f"{name}_{part}" for name in schema.LANDMARKS for part in ("x", "y", "z", "vis")]
SMOOTHED = ("vel_y_smooth", "accel_y_smooth", "specific_power_y_smooth")


def rounded(name: str, digits: int = 6):
    """Rounded for comparison, without negative zero."""
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def analysis_columns():
    return [
        rounded(name, 4 if name in SMOOTHED else 6) if kind.typeName() == "double"
        else F.col(name)
        for name, kind in schema.ANALYSIS_TYPES.items()
    ]


class Fleet:
    """The clip tables of one data directory, and the steps that queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK):
        self.spark = spark
        self.span_rows = rows_per_task
        self.tables = EventTables(spark, sf_dir, rows_per_task)
        self.span = self.tables.span

    @cached_property
    def clips(self):
        return clip_defaults(self.tables.clips)

    @property
    def frames(self):
        return self.tables.frames

    @property
    def landmarks(self):
        return self.tables.landmarks

    def sized(self):
        return with_clip_metadata(self.frames, self.tables.clips, self.span)

    def analysis(self):
        return fleet.analysis(self.frames, self.clips, self.landmarks, self.span)

    def clamped(self):
        wanted = detection.filter_detections(self.tables.detections, names=CLASS_NAMES)
        return detection.clamp_boxes(wanted, self.clips, self.span)

    def candidates(self):
        feet = detection.feet_position(self.landmarks, self.clips, self.span)
        return detection.candidates(self.clamped(), feet)

    def collected(self):
        return detection.collect_frames(
            self.frames, self.clips, self.tables.detections, self.landmarks, self.tables.flow,
            names=CLASS_NAMES, span=self.span)

    def full_analysis(self):
        """The analysis of frames whose bar comes from the detections."""
        return fleet.analysis(self.collected(), self.clips, self.landmarks, self.span)

    def bar(self):
        """The bar's part of that analysis, in which the pose plays no part."""
        frames = self.collected().select(
            *KEY, "barbell_x_raw", "barbell_y_raw", "shake_dx", "shake_dy")
        timed = with_clip_metadata(frames, self.tables.clips, self.span)
        return kinematics.kinematics(timed.drop("frame_width", "frame_height"), self.span)

    def posed(self):
        wide = pose.widen_landmarks(self.landmarks)
        return with_clip_metadata(wide, self.tables.clips, self.span)

    def states(self):
        analysed = write_scratch(self.full_analysis().select(*overlay.STATED))
        plan = overlay.render_plan(analysed, self.clips, self.span)
        return overlay.frame_state(plan, analysed, self.span)

    def trail(self):
        """The path's segments, and the shift of every drawn frame."""
        moved = write_scratch(self.bar().select(*overlay.SHIFTED))
        plan = overlay.render_plan(moved, self.clips, self.span)
        return overlay.path_trail(moved, self.span), overlay.frame_shift(plan, moved, self.span)

    def critique(self):
        return faults.critique(self.analysis(), self.clips, self.span)


class RoughFleet(Fleet):
    """The clips that are left of a rough fleet once the unusable ones are set aside."""

    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK):
        super().__init__(spark, sf_dir, rows_per_task)
        self.tables = RoughTables(spark, sf_dir, rows_per_task)

    @cached_property
    def good(self):
        return validate_tracks(self.tables.tracks())[0]

    @cached_property
    def clips(self):
        return clip_defaults(self.good.clips)

    @property
    def frames(self):
        return self.good.frames

    @property
    def landmarks(self):
        return self.good.landmarks

    def sized(self):
        return with_clip_metadata(self.frames, self.good.clips, self.span)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the technique faults of every clip."""
    return faults.faults(Fleet(spark, "/root/testdata/sf0.001").critique())


# --- sources and sinks --------------------------------------------------------------

def q_read_tracks(f: Fleet):
    path = scratch_path(f.spark, "tracks")
    f.tables.clips.write.parquet(f"{path}/clips")
    schema.with_missing_columns(f.frames, schema.FRAMES).write.parquet(f"{path}/frames")
    return read_tracks(f.spark, path).frames.select(
        *KEY, "barbell_x_raw", "barbell_y_raw", "shake_dx", "shake_dy")


def q_write_analysis(f: Fleet):
    path = scratch_path(f.spark, "analysis")
    sinks.write_analysis(f.full_analysis(), path)
    return sinks.read_analysis(f.spark, path).select(*KEY, *analysis_columns())


def q_import_analysis_csv(f: Fleet):
    path = scratch_path(f.spark, "csv")
    sinks.export_analysis_csv(f.full_analysis(), path, compression="gzip")
    return sinks.import_analysis_csv(f.spark, path).select(*KEY, *analysis_columns())


def q_landmark_text(f: Fleet):
    packed = pose.pack_landmarks(f.landmarks)
    texts = packed.select(*KEY, landmarks_to_text(F.col("landmarks")).alias("landmarks_str"))
    back = text_to_landmarks(F.col("landmarks_str"))
    return texts.select(
        *KEY, "landmarks_str", F.size(back).cast("bigint").alias("n_points"),
        back["left_hip"]["vis"].alias("left_hip_vis"))


def q_box_text(f: Fleet):
    sides = [F.col(side) for side in detection.BOX]
    texts = f.tables.detections.select(*KEY, "det_id", box_to_text(*sides).alias("box_str"))
    return texts.withColumn("b", text_to_box(F.col("box_str"))).select(
        *KEY, "det_id", "box_str", "b.*")


def q_write_report(f: Fleet):
    path = scratch_path(f.spark, "reports")
    sinks.write_report(report.report_markdown(f.critique()), path)
    return f.spark.read.parquet(path)


# --- detection and shake -------------------------------------------------------------

def q_filter_detections(f: Fleet, class_name="endcap", names=CLASS_NAMES):
    return detection.filter_detections(
        f.tables.detections, class_name, names=names).drop("class_id")


def q_clamp_boxes(f: Fleet):
    return f.clamped().select(*KEY, "det_id", *detection.BOX, "cx", "cy")


def q_feet_position(f: Fleet):
    feet = detection.feet_position(f.landmarks, f.clips, f.span)
    return feet.select(*KEY, rounded("feet_x"), rounded("feet_y"))


def q_initial_endcap(f: Fleet):
    return detection.initial_endcap(f.candidates()).drop(*detection.BOX)


def q_track_endcap(f: Fleet):
    return detection.track_endcap(f.candidates(), f.span)


def q_pack_landmarks(f: Fleet):
    return pose.pack_landmarks(f.landmarks).select(
        *KEY, F.size("landmarks").cast("bigint").alias("n_landmarks"),
        F.col("landmarks")["left_hip"]["x"].alias("left_hip_x"),
        F.col("landmarks")["right_wrist"]["vis"].alias("right_wrist_vis"))


def q_estimate_shake(f: Fleet):
    return detection.estimate_shake(f.frames, f.tables.flow, f.span)


# --- frame enrichment ------------------------------------------------------------------

def q_unpack_landmarks(f: Fleet):
    return pose.unpack_landmarks(pose.widen_landmarks(f.landmarks)).select(*KEY, *POSE)


def q_unpack_landmark_map(f: Fleet):
    spread = pose.spread_landmarks(pose.pack_landmarks(f.landmarks))
    return pose.unpack_landmarks(spread).select(*KEY, *POSE)


def q_lifter_angle(f: Fleet):
    wide = pose.widen_landmarks(f.landmarks)
    return pose.with_lifter_angle(wide).select(*KEY, rounded("lifter_angle_deg"))


def q_pixel_coordinates(f: Fleet):
    sized = with_clip_metadata(f.landmarks, f.tables.clips, f.span)
    size = F.col("frame_width"), F.col("frame_height")
    x_px, y_px = to_pixels(F.col("x"), F.col("y"), *size)
    x_norm, y_norm = to_normalized(x_px, y_px, *size)
    return sized.select(
        *KEY, "landmark", x_px.alias("x_px"), y_px.alias("y_px"), x_norm.alias("x_norm"),
        y_norm.alias("y_norm"),
    ).select(*KEY, "landmark", *[rounded(c) for c in ("x_px", "y_px", "x_norm", "y_norm")])


def q_joint_angles(f: Fleet):
    posed = pose.with_joint_angles(pose.unpack_landmarks(f.posed()))
    return posed.select(*KEY, *[rounded(c) for c in pose.JOINT_POINTS])


def q_hip_height(f: Fleet):
    return pose.with_hip_height(pose.unpack_landmarks(f.posed())).select(
        *KEY, rounded("hip_y_avg"))


def q_unpack_center(f: Fleet):
    frames = f.collected().select(*KEY, F.when(F.col("barbell_x_raw").isNotNull(), F.struct(
        F.col("barbell_x_raw").alias("x"), F.col("barbell_y_raw").alias("y"),
    )).alias("barbell_center"))
    return kinematics.unpack_center(frames).select(*KEY, "barbell_x_raw", "barbell_y_raw")


def q_stabilize(f: Fleet):
    steady = kinematics.stabilize(kinematics.cumulative_shake(f.frames, f.span))
    return steady.select(*KEY, rounded("barbell_x_stable"), rounded("barbell_y_stable"))


def q_detection_rate(f: Fleet):
    rates = kinematics.detection_rate(kinematics.stable_track(f.frames, f.span))
    return rates.withColumn("detection_rate", rounded("detection_rate"))


# --- kinematics ------------------------------------------------------------------------

def q_timed(f: Fleet, column):
    timed = kinematics.time_axis(kinematics.stable_track(f.sized(), f.span))
    return timed.select(*KEY, rounded(column))


def q_bar_velocity(f: Fleet):
    timed = kinematics.time_axis(kinematics.stable_track(f.sized(), f.span))
    return kinematics.velocity(timed).select(*KEY, rounded("vel_y_px_s"))


def q_smoothed(f: Fleet, column, digits=6):
    return kinematics.smoothed_track(f.sized(), f.span).select(*KEY, rounded(column, digits))


def q_accelerated(f: Fleet, column):
    moving = kinematics.acceleration(kinematics.smoothed_track(f.sized(), f.span), f.span)
    return moving.select(*KEY, rounded(column, 4))


def q_velocity_threshold(f: Fleet):
    moving = kinematics.acceleration(kinematics.smoothed_track(f.sized(), f.span), f.span)
    return moving.groupBy("clip_id").agg(
        F.max("vel_threshold").alias("vel_threshold")).select(
            "clip_id", rounded("vel_threshold", 4))


def q_kinematics(f: Fleet, column):
    return kinematics.kinematics(f.sized(), f.span).select(*KEY, column)


# --- charts and overlay -------------------------------------------------------------------

def q_chart_series(f: Fleet):
    moved = kinematics.kinematics(f.sized(), f.span)
    return charts.chart_series(moved, f.span).select(
        "clip_id", "metric", "frame", rounded("time_s"), rounded("value", 4))


def q_chart_extent(f: Fleet):
    moved = kinematics.kinematics(f.sized(), f.span)
    return charts.chart_extent(charts.chart_series(moved, f.span)).select(
        "clip_id", "metric", rounded("min_value", 4), rounded("max_value", 4), "zero_line")


def q_chart_status(f: Fleet, report_on):
    return report_on(f.clips, kinematics.kinematics(f.sized(), f.span))


def q_bar_path_segments(f: Fleet):
    return charts.bar_path_segments(f.bar(), f.span).select(
        "clip_id", "segment", "frame", rounded("x"), rounded("y"), "bar_phase", "color",
        "label", "direction")


def q_bar_path_markers(f: Fleet):
    moved = kinematics.stable_track(f.collected(), f.span)
    return charts.bar_path_markers(moved).select("clip_id", *[
        rounded(f"{end}_{c}") if c != "frame" else F.col(f"{end}_{c}")
        for end in ("start", "end") for c in ("frame", "x", "y")])


def q_render_plan(f: Fleet):
    return overlay.render_plan(
        kinematics.stable_track(f.collected(), f.span), f.clips, f.span).select(*KEY)


def q_frame_state(f: Fleet):
    return f.states().select(
        *KEY, "analysed", "shake_x", "shake_y", rounded("lifter_angle_deg"), rounded("time_s"),
        "path_points")


def q_path_trail(f: Fleet):
    return overlay.path_trail(f.bar(), f.span).select(
        "clip_id", "segment", "frame", *[rounded(c) for c in ("x1", "y1", "x2", "y2")], "color")


def q_path_trail_last_frame(f: Fleet):
    trail, shifts = f.trail()
    return overlay.trail_on_frames(trail, overlay.last_states(shifts), f.span)


def q_trail_frames(f: Fleet, top=overlay.TOP):
    """Every frame's trail as polylines, with the pixels that each begins and ends at."""
    trail, shifts = f.trail()
    pieces = overlay.trail_pieces(trail, top)
    ends = pieces.select(
        "clip_id", "level", "number", F.col("segments")[0].alias("a"),
        F.element_at("segments", -1).alias("b"))
    shown = overlay.frame_pieces(shifts, top)
    # of a run of the longest, its last polyline
    last = shown.withColumn("number", F.col("number") + F.col("count") - 1)
    return last.join(ends, ["clip_id", "level", "number"]).select(
        *KEY, F.col("level").cast("bigint").alias("level"), "number", "count",
        F.col("a.segment").alias("first_segment"), F.col("b.segment").alias("last_segment"),
        *[truncate(F.col(end)[c] + F.col(f"shake_{c[0]}")).alias(c)
          for end, c in (("a", "x1"), ("a", "y1"), ("b", "x2"), ("b", "y2"))])


def q_trail_all_frames(f: Fleet):
    """Segments and pixel sums of every frame's whole trail, written out piece by piece."""
    trail, shifts = f.trail()
    drawn = overlay.trail_on_frames(trail, shifts, f.span, top=3)
    return drawn.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("segments"),
        *[F.sum(c).alias(f"sum_{c}") for c in ("x1", "y1", "x2", "y2")])


def q_edge_colors(f: Fleet):
    edges = overlay.skeleton_edges(f.full_analysis())
    bgr = F.create_map(*[
        F.lit(cell) for name, value in schema.COLORS_BGR.items()
        for cell in (name, ",".join(map(str, value)))])
    return edges.groupBy("clip_id", "color").agg(F.count(F.lit(1)).alias("edges")).withColumn(
        "bgr", F.element_at(bgr, F.col("color")))


def q_captions(f: Fleet):
    return overlay.captions(f.states())


def q_overlay(f: Fleet):
    analysed = write_scratch(f.full_analysis().select(*overlay.DRAWN))
    drawn = overlay.overlay(analysed, f.clips, f.span)
    return drawn.select(
        *KEY, "kind", "color", *[rounded(c) for c in ("x1", "y1", "x2", "y2")], "text")


# --- phases, faults, report -----------------------------------------------------------------

def q_baseline(f: Fleet):
    return phases.with_baseline(f.analysis(), f.span).groupBy("clip_id").agg(
        F.max("baseline_y").alias("baseline_y")).select("clip_id", rounded("baseline_y"))


def q_border(f: Fleet, name):
    marked = phases.mark_borders(f.analysis(), f.span)
    return marked.groupBy("clip_id").agg(F.max(F.col(f"_{name}")["frame"]).alias(name))


def q_phase_slices(f: Fleet):
    analysed = write_scratch(f.analysis())
    return phases.phase_slices(analysed, phases.phases(analysed, f.span), f.span)


def q_fault(f: Fleet, code, ankle_units="as_is"):
    flags = faults.fault_flags(faults.clip_measures(f.analysis(), f.span), ankle_units)
    return flags.select("clip_id", F.col(code).alias(code.lower()))


def q_phase_durations(f: Fleet):
    timed = faults.phase_durations(faults.clip_measures(f.analysis(), f.span))
    names = [f"{name}_s" for name, _, _ in phases.PHASES] + ["total_s"]
    return timed.select("clip_id", *[rounded(name) for name in names])


# --- whole runs -------------------------------------------------------------------------------

def q_run_summary(f: Fleet):
    analysed = write_scratch(f.analysis())
    summary = fleet.run_summary(
        f.clips, f.frames, analysed, charts.skipped_charts(f.clips, analysed),
        faults.critique(analysed, f.clips, f.span), f.span)
    return summary.withColumn("detection_rate", rounded("detection_rate"))


def q_analyze_detections(f: Fleet):
    summary = fleet.analyze(f.tables.tracks(), names=CLASS_NAMES)["run_summary"]
    return summary.withColumn("detection_rate", rounded("detection_rate"))


def q_analyze_rough(f: RoughFleet, part):
    """A table of the whole run over the rough fleet, which sets its bad clips aside itself."""
    return fleet.analyze(f.tables.tracks())[part]


def q_analyze_incremental(f: Fleet):
    """Two runs over a folder of clips; the second finds old clips announced again."""
    path = scratch_path(f.spark, "growing")
    for name, rows in (("frames", schema.with_missing_columns(f.frames, schema.FRAMES)),
                       ("landmarks", f.landmarks)):
        rows.write.parquet(f"{path}/{name}")
    for part in (F.col("clip_id") % 3 != 0, F.lit(True)):
        f.tables.clips.where(part).write.mode("append").parquet(f"{path}/clips")
        incremental.analyze_new(f.spark, path, f"{path}/out", f"{path}/checkpoint",
                                overlay_table=False)
    found = incremental.read_results(f.spark, f"{path}/out", "faults")
    return found.select("clip_id", "ord", "code", "message", "run")


def q_run_counts(f: RoughFleet):
    """What a run over the stored rough fleet counts in passing."""
    path = scratch_path(f.spark, "rough")
    tables = {"clips": f.tables.clips, "landmarks": f.tables.landmarks,
              "frames": schema.with_missing_columns(f.tables.frames, schema.FRAMES).withColumn(
                  "shake_dx", F.when(F.col("frame") % 10 == 7, F.lit(float("nan"))).otherwise(
                      F.col("shake_dx"))),
              "detections": f.tables.detections}
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
    counts = Counts()
    tracks = read_tracks(f.spark, path, counts)
    out = fleet.analyze(tracks, names=CLASS_NAMES, overlay_table=False, counts=counts)
    return out["run_counts"].where("source <> 'analysis'")


def q_clustered_join(f: Fleet):
    """Stored analysis and pose, joined and summed up by clip where they lie."""
    path, tag = scratch_path(f.spark, "clustered"), uuid.uuid4().hex
    named = {"analysis": f.analysis().select(*KEY, "barbell_y_stable", "time_s"),
             "ankles": f.landmarks.where("landmark = 'left_ankle'").select(*KEY, "y", "vis")}
    for name, rows in named.items():
        clustered.save_clustered(rows, f"{name}_{tag}", f"{path}/{name}", 8, f.span_rows)
    bars, ankles = [clustered.read_clustered(f.spark, f"{name}_{tag}") for name in named]
    sums = clustered.sum_up_clips(
        clustered.join_clustered(bars, ankles), ("frames", F.lit(1)),
        ("seen", (F.col("vis") > 0.3).cast("bigint")), ("ankle_y", F.col("y")),
        ("bar_y", F.col("barbell_y_stable")))
    return sums.select("clip_id", "frames", "seen", rounded("ankle_y"), rounded("bar_y", 4))


def stream_columns(out: DataFrame):
    totals = ("total_shake_x", "total_shake_y", "barbell_x_stable", "barbell_y_stable")
    return out.where("not cast(late as boolean)").select(
        *KEY, "det_id", "cx", "cy", *[rounded(c) for c in totals], "late_frames")


def q_track_endcap_stream(f: Fleet):
    """The stream in two deliveries, the later frames of every clip after the earlier."""
    path = scratch_path(f.spark, "stream")
    rows = write_scratch(frame_stream(f.frames, f.candidates(), f.span))
    middle = rows.agg(F.expr("percentile_approx(frame, 0.5)")).first()[0]
    for delivery in (F.col("frame") <= middle, F.col("frame") > middle):
        rows.where(delivery).write.mode("append").parquet(f"{path}/in")
        stream = f.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        run_available(stream, f"{path}/out", f"{path}/checkpoint")
    return stream_columns(f.spark.read.parquet(f"{path}/out"))


def q_track_endcap_stream_bounded(f: Fleet):
    """The stream one file at a time, with the frames of every clip dealt over all files."""
    path = scratch_path(f.spark, "stream")
    rows = frame_stream(f.frames, f.candidates(), f.span)
    rows.repartition(4, F.hash("clip_id", "frame")).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/in")
    run_available(stream, f"{path}/out", f"{path}/checkpoint")
    return stream_columns(f.spark.read.parquet(f"{path}/out"))


def q_track_endcap_stream_gaps(f: Fleet):
    """The stream without some frames, which come when their clips have gone on; all rows."""
    path = scratch_path(f.spark, "stream")
    last = f.frames.groupBy("clip_id").agg(F.max("frame").alias("last"))
    rows = write_scratch(f.span.attach(
        frame_stream(f.frames, f.candidates(), f.span), last).withColumn(
        "lost", (F.col("frame") % 17 == 5) & (F.col("frame") < F.col("last"))).drop("last"))
    day = F.lit("2024-01-01").cast("timestamp")
    idle = f.spark.range(1).select(*[
        F.lit(None).cast(field.dataType).alias(field.name) for field in rows.drop("lost").schema])
    for days, part in enumerate((rows.where("not lost").drop("lost"), idle,
                                 rows.where("lost").drop("lost"))):
        part.withColumn("arrived", day + F.make_dt_interval(F.lit(3 * days))).write.mode(
            "append").parquet(f"{path}/in")
        stream = f.spark.readStream.schema(
            f.spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
        run_available(stream, f"{path}/out", f"{path}/checkpoint")
    totals = ("total_shake_x", "total_shake_y", "barbell_x_stable", "barbell_y_stable")
    return f.spark.read.parquet(f"{path}/out").select(
        *KEY, "det_id", "cx", "cy", *[rounded(c) for c in totals],
        F.col("late").cast("boolean").alias("late"))


def q_track_endcap_raw_stream(f: Fleet):
    """Four raw streams, delivered in parts that overlap in time, against the batch."""
    path = scratch_path(f.spark, "raw")
    raw = {"frames": f.frames.select(*KEY), "detections": f.tables.detections,
           "landmarks": f.landmarks, "flow": f.tables.flow}
    start = 1_704_067_200_000

    def timed(rows):
        return rows.withColumn("at", F.timestamp_millis(F.lit(start) + F.col("frame") * 33))

    raw = {name: write_scratch(timed(rows)) for name, rows in raw.items()}
    for delivery in range(3):
        for name, rows in raw.items():
            shaken = F.col("frame") + F.pmod(F.xxhash64(*rows.columns), F.lit(7))
            part = (rows.where(shaken < 36), rows.where(shaken >= 36), rows.limit(1).select(*[
                F.timestamp_millis(F.lit(2 * start)).alias(c) if c == "at"
                else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes]))[delivery]
            part.write.mode("append").parquet(f"{path}/{name}")
        streams = [f.spark.readStream.schema(rows.schema).parquet(f"{path}/{name}")
                   for name, rows in raw.items()]
        tracked = track_raw_stream(*streams, clips=f.clips, names=CLASS_NAMES)
        run_available(streams[0], f"{path}/out", f"{path}/checkpoint", tracked=tracked)
    return stream_columns(f.spark.read.parquet(f"{path}/out"))


_QUERIES = {
    "read_tracks": q_read_tracks,
    "with_clip_metadata": lambda f: f.sized().select(
        *KEY, "frame_width", "frame_height", "fps"),
    "write_analysis": q_write_analysis,
    "import_analysis_csv": q_import_analysis_csv,
    "landmark_text": q_landmark_text,
    "box_text": q_box_text,
    "write_report": q_write_report,
    "filter_detections": q_filter_detections,
    "filter_detections_unknown_class": lambda f: q_filter_detections(f, class_name="barbell"),
    "filter_detections_unnamed": lambda f: q_filter_detections(f, names=None),
    "clamp_boxes": q_clamp_boxes,
    "feet_position": q_feet_position,
    "initial_endcap": q_initial_endcap,
    "track_endcap": q_track_endcap,
    "pack_landmarks": q_pack_landmarks,
    "estimate_shake": q_estimate_shake,
    "collect_frames": lambda f: f.collected(),
    "frame_gaps": lambda f: kinematics.frame_gaps(f.frames, f.span),
    "unpack_landmarks": q_unpack_landmarks,
    "unpack_landmark_map": q_unpack_landmark_map,
    "lifter_angle": q_lifter_angle,
    "pixel_coordinates": q_pixel_coordinates,
    "joint_angles": q_joint_angles,
    "hip_height": q_hip_height,
    "cumulative_shake": lambda f: kinematics.cumulative_shake(f.frames, f.span).select(
        *KEY, "total_shake_x", "total_shake_y"),
    "unpack_center": q_unpack_center,
    "stabilize": q_stabilize,
    "truncate_at_peak": lambda f: kinematics.stable_track(f.frames, f.span).select(
        *KEY, rounded("barbell_y_stable")),
    "final_projection": lambda f: f.analysis().select(*KEY, *analysis_columns()),
    "detection_rate": q_detection_rate,
    "time_axis": lambda f: q_timed(f, "time_s"),
    "frame_interval": lambda f: q_timed(f, "dt"),
    "bar_velocity": q_bar_velocity,
    "interpolate_velocity": lambda f: q_smoothed(f, "vel_filled"),
    "smooth_velocity": lambda f: q_smoothed(f, "vel_y_smooth", 4),
    "velocity_threshold": q_velocity_threshold,
    "direction_state": lambda f: q_kinematics(f, "direction_state"),
    "phase_change": lambda f: q_kinematics(f, "phase_change"),
    "bar_phase": lambda f: q_kinematics(f, "bar_phase"),
    "acceleration": lambda f: q_accelerated(f, "accel_y_smooth"),
    "specific_power": lambda f: q_accelerated(f, "specific_power_y_smooth"),
    "chart_series": q_chart_series,
    "chart_extent": q_chart_extent,
    "chart_status": lambda f: q_chart_status(f, charts.chart_status),
    "skipped_charts": lambda f: q_chart_status(f, charts.skipped_charts),
    "bar_path_segments": q_bar_path_segments,
    "bar_path_markers": q_bar_path_markers,
    "render_plan": q_render_plan,
    "frame_state": q_frame_state,
    "path_trail": q_path_trail,
    "path_trail_last_frame": q_path_trail_last_frame,
    "trail_frames": q_trail_frames,
    "trail_frames_short": lambda f: q_trail_frames(f, top=3),
    "trail_all_frames": q_trail_all_frames,
    "box_primitives": lambda f: overlay.box_primitives(f.full_analysis()),
    "skeleton_edges": lambda f: overlay.skeleton_edges(f.full_analysis()),
    "edge_colors": q_edge_colors,
    "joint_points": lambda f: overlay.joint_points(f.full_analysis()),
    "captions": q_captions,
    "overlay": q_overlay,
    "baseline_y": q_baseline,
    **{f"phase_{t}": (lambda f, t=t: q_border(f, t)) for t in phases.BORDERS},
    "lift_phases": lambda f: phases.phases(f.analysis(), f.span),
    "phase_slices": q_phase_slices,
    **{f"fault_{code.lower()}": (lambda f, code=code: q_fault(f, code)) for code in schema.FAULTS},
    "fault_sp_jump_px": lambda f: q_fault(f, "SP_JUMP", "px"),
    "faults": lambda f: faults.faults(f.critique()),
    "route_lift_type": lambda f: faults.route_lift_type(f.clips),
    "phase_durations": q_phase_durations,
    "critique_status": lambda f: faults.critique_status(f.critique()),
    "report_markdown": lambda f: report.report_markdown(f.critique()),
    "run_summary": q_run_summary,
    "analyze_detections": q_analyze_detections,
    "analyze_incremental": q_analyze_incremental,
    "clustered_join": q_clustered_join,
    "validate_tracks": lambda f: clip_problems(f.tables.clips, f.frames),
    "track_endcap_stream": q_track_endcap_stream,
    "track_endcap_stream_bounded": q_track_endcap_stream_bounded,
    "track_endcap_stream_gaps": q_track_endcap_stream_gaps,
    "track_endcap_raw_stream": q_track_endcap_raw_stream,
}


#: Queries over the rough fleet, in which every kind of problem occurs.
_ROUGH = {
    "validate_tracks_rough": lambda f: clip_problems(f.tables.clips, f.tables.frames),
    "chart_status_rough": lambda f: q_chart_status(f, charts.chart_status),
    "skipped_charts_rough": lambda f: q_chart_status(f, charts.skipped_charts),
    "lift_phases_rough": _QUERIES["lift_phases"],
    "fault_sp_jump_rough": _QUERIES["fault_sp_jump"],
    "fault_sp_jump_px_rough": _QUERIES["fault_sp_jump_px"],
    "critique_status_rough": _QUERIES["critique_status"],
    "final_projection_rough": _QUERIES["final_projection"],
    "empty_columns_rough": lambda f: schema.empty_columns(
        f.analysis().drop("right_shoulder_y"), phases.REQUIRED),
    "run_counts": q_run_counts,
    "analyze_quarantined": lambda f: q_analyze_rough(f, "quarantined"),
    "analyze_faults": lambda f: q_analyze_rough(f, "faults"),
    "analyze_status": lambda f: q_analyze_rough(f, "critique_status"),
    "analyze_skipped_charts": lambda f: q_analyze_rough(f, "skipped_charts"),
    "analyze_report": lambda f: q_analyze_rough(f, "report"),
    "analyze_run_summary": lambda f: q_analyze_rough(f, "run_summary").withColumn(
        "detection_rate", rounded("detection_rate")),
}

#: Queries that are also run with their clips cut into blocks, as very long clips are.
_BLOCKED = ("final_projection", "track_endcap", "faults", "overlay", "chart_series",
            "bar_path_segments", "frame_state", "analyze_detections", "trail_all_frames",
            "clustered_join")
BLOCKED_ROWS = 20


def optional_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query over the tables in ``sf_dir``."""
    whole = {
        name: (lambda spark, sf_dir, build=build: build(Fleet(spark, sf_dir)))
        for name, build in _QUERIES.items()
    }
    blocked = {
        f"{name}_in_blocks": (lambda spark, sf_dir, build=_QUERIES[name]: build(
            Fleet(spark, sf_dir, BLOCKED_ROWS)))
        for name in _BLOCKED
    }
    rough = {
        name: (lambda spark, sf_dir, build=build: build(RoughFleet(spark, sf_dir)))
        for name, build in _ROUGH.items()
    }
    return whole | rough | blocked | optional_queries()


def oracle_sql() -> dict[str, str]:
    """The same results in SQL over the driver's tables."""
    twins = oracle.all_sql()
    blocked = {f"{name}_in_blocks": twins[name] for name in _BLOCKED}
    return twins | blocked | (llm.oracle_sql() if llm else {})
