"""Reading clip tables, giving them their metadata, and setting bad clips aside."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftengine import schema
from liftengine.plans.span import Whole, measure
from liftengine.sources.counts import Counts
from liftengine.sources.scratch import write_scratch


@dataclass(frozen=True)
class Tracks:
    """The tables of a fleet of clips, with the span that suits the longest clip.

    ``frames`` may carry the bar position, shake and landmark map itself;
    ``landmarks``, ``detections`` and ``flow`` are the long tables they come from.
    """

    clips: DataFrame
    frames: DataFrame
    landmarks: DataFrame | None = None
    detections: DataFrame | None = None
    flow: DataFrame | None = None
    span: object = Whole()

    def with_frames(self, frames: DataFrame) -> "Tracks":
        return replace(self, frames=frames)


def _known(value):
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value here: Spark orders NaN above every number."""
    cleaned = {
        f.name: _known(F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if "landmarks" in df.columns:
        parts = schema.LANDMARK_POINT.names
        cleaned["landmarks"] = F.transform_values("landmarks", lambda name, point: F.struct(
            *[_known(point[part]).alias(part) for part in parts]))
    return df.withColumns(cleaned)


def read_tracks(spark: SparkSession, path: str, counts: Counts | None = None) -> Tracks:
    """Load ``clips`` and ``frames`` below ``path``, and the long tables that exist there.

    With ``counts``, rows and those with NaN are counted by the jobs that read the tables.
    """
    def table(name, declared):
        stored = spark.read.schema(declared).parquet(f"{path}/{name}")
        return nan_to_null(counts.watch_source(stored, name) if counts else stored)

    def optional(name, declared):
        try:
            return table(name, declared)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    frames = table("frames", schema.FRAMES)
    return Tracks(
        clips=table("clips", schema.CLIPS),
        frames=frames,
        landmarks=optional("landmarks", schema.LANDMARK_ROWS),
        detections=optional("detections", schema.DETECTIONS),
        flow=optional("flow", schema.FLOW),
        # looked up in the key column alone, apart from what is counted
        span=measure(spark.read.schema(schema.FRAMES).parquet(f"{path}/frames")),
    )


def clip_defaults(clips: DataFrame) -> DataFrame:
    """Clip metadata with the stated defaults where a clip has none."""
    return clips.withColumns({
        "frame_width": F.coalesce("frame_width", F.lit(schema.DEFAULT_WIDTH)).cast("bigint"),
        "frame_height": F.coalesce("frame_height", F.lit(schema.DEFAULT_HEIGHT)).cast("bigint"),
        "fps": F.coalesce("fps", F.lit(schema.DEFAULT_FPS)),
    })


def with_clip_metadata(frames: DataFrame, clips: DataFrame, span=Whole()) -> DataFrame:
    """Frame size and rate on every frame, also on those of clips without metadata."""
    joined = span.attach(frames, clips.select("clip_id", "frame_width", "frame_height", "fps"))
    return clip_defaults(joined)


def clip_problems(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per clip with ``problem``: no_frames, bad_fps, duplicate_frame or NULL.

    Frames are counted per (clip, frame) first, so a long clip is spread out.
    """
    counted = (
        frames.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("clip_id").agg(
            F.sum("n").alias("n_frames"),
            F.max("n").alias("_most"),
        )
    )
    problem = (
        F.when(F.coalesce("n_frames", F.lit(0)) == 0, "no_frames")
        .when(F.coalesce("fps", F.lit(schema.DEFAULT_FPS)) <= 0, "bad_fps")
        .when(F.col("_most") > 1, "duplicate_frame")
    )
    return clips.join(counted, "clip_id", "left").select(
        "clip_id", F.coalesce("n_frames", F.lit(0)).cast("bigint").alias("n_frames"),
        problem.alias("problem"),
    )


def validate_tracks(tracks: Tracks) -> tuple[Tracks, DataFrame]:
    """Split off unusable clips: the remaining tracks, and one row per clip set aside.

    The bad clips are written out first.  Normally there are none, and the tables are
    then passed on as they are.
    """
    bad = write_scratch(
        clip_problems(tracks.clips, tracks.frames).where("problem IS NOT NULL"), "quarantine")
    if bad.isEmpty():
        return tracks, bad
    marks = bad.select("clip_id", F.lit(True).alias("_bad"))

    def keep(df):
        if df is None:
            return None
        return tracks.span.attach(df, marks).where("_bad IS NULL").select(*df.columns)

    return replace(
        tracks, clips=tracks.clips.join(marks, "clip_id", "left_anti"),
        frames=keep(tracks.frames), landmarks=keep(tracks.landmarks),
        detections=keep(tracks.detections), flow=keep(tracks.flow),
    ), bad
