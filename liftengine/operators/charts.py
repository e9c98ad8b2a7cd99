"""Chart series, extents and the coloured bar path, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.schema import CHART_TITLES, PATH_CHART_TITLE, PHASE_COLORS, PHASE_LABELS
from liftengine.plans.span import Previous, RunningSum, Total, Whole

# fixed values: points that a chart needs
MIN_SERIES_POINTS = 2
# a bar path is drawn from more points than this
MIN_PATH_POINTS = 2


def chart_series(analysis: DataFrame, span=Whole()) -> DataFrame:
    """Long (clip, metric, time, value) of each metric with at least two points."""
    needed = analysis.select("clip_id", "frame", "time_s", *CHART_TITLES)
    counted = span.derive(needed, **{
        f"_n_{metric}": Total("sum", F.col(metric).isNotNull().cast("bigint"))
        for metric in CHART_TITLES
    })
    points = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("value"),
                 F.col(f"_n_{metric}").alias("n"))
        for metric in CHART_TITLES
    ])
    return (
        counted.select("clip_id", "frame", "time_s", F.inline(points))
        .where(F.col("value").isNotNull() & (F.col("n") >= MIN_SERIES_POINTS))
        .select("clip_id", "metric", "frame", "time_s", "value")
    )


def chart_extent(series: DataFrame) -> DataFrame:
    """Per clip and metric: range of values, and whether zero lies inside it."""
    return series.groupBy("clip_id", "metric").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    ).withColumn("zero_line", (F.col("min_value") < 0) & (F.col("max_value") > 0))


def chart_status(clips: DataFrame, analysis: DataFrame) -> DataFrame:
    """Each clip's charts with the points there are, and whether they suffice."""
    on_path = F.col("barbell_x_stable").isNotNull() & F.col("barbell_y_stable").isNotNull()
    counts = analysis.groupBy("clip_id").agg(
        *[F.count(metric).alias(metric) for metric in CHART_TITLES],
        F.count_if(on_path).alias("path"))
    needed = {metric: (title, MIN_SERIES_POINTS) for metric, title in CHART_TITLES.items()}
    needed["path"] = (PATH_CHART_TITLE, MIN_PATH_POINTS + 1)
    charts = F.array(*[
        F.struct(F.lit(title).alias("chart"), F.coalesce(column, F.lit(0)).alias("points"),
                 F.lit(least).alias("needed"))
        for column, (title, least) in needed.items()
    ])
    status = (
        F.when(F.col("points") >= F.col("needed"), "produced")
        .when(F.col("points") == 0, "missing").otherwise("insufficient"))
    return (
        clips.select("clip_id").join(counts, "clip_id", "left")
        .select("clip_id", F.inline(charts))
        .select("clip_id", "chart", "points", status.alias("status")))


def skipped_charts(clips: DataFrame, analysis: DataFrame) -> DataFrame:
    """The charts that a clip is too thin for, and why."""
    return chart_status(clips, analysis).where("status <> 'produced'").withColumnRenamed(
        "status", "reason")


def path_points(analysis: DataFrame) -> DataFrame:
    """The rows of the analysis that lie on the bar path."""
    return analysis.where("barbell_x_stable IS NOT NULL AND barbell_y_stable IS NOT NULL")


def phase_color(phase):
    return F.element_at(F.array(*map(F.lit, PHASE_COLORS)), (phase % 3).cast("int") + 1)


def phase_label(phase):
    return F.element_at(F.array(*map(F.lit, PHASE_LABELS)), (phase % 3).cast("int") + 1)


def bar_path_segments(analysis: DataFrame, span=Whole()) -> DataFrame:
    """The bar path by movement phase: one row per (segment, point).

    A segment runs on to the first point of the next one, so that point has two rows.  A
    phase that begins on the last point has no segment of its own.  Colour and label
    follow the phase number modulo 3; ``direction`` is the real one.
    """
    points = path_points(analysis).select(
        "clip_id", "frame", "barbell_x_stable", "barbell_y_stable", "bar_phase",
        "direction_state")
    seen = span.derive(
        points,
        _before=Previous(F.struct("bar_phase", "direction_state")),
        _points=Total("sum", F.lit(1)),
        _last_frame=Total("max", F.col("frame")),
    ).where(F.col("_points") > MIN_PATH_POINTS)
    before = F.col("_before")
    starts = before.isNull() | (before["bar_phase"] != F.col("bar_phase"))
    runs = span.derive(seen, segment=RunningSum(starts.cast("bigint")))

    def member(segment, phase, direction):
        return F.struct(segment.alias("segment"), phase.alias("bar_phase"),
                        direction.alias("direction_state"))

    own = member(F.col("segment"), F.col("bar_phase"), F.col("direction_state"))
    shared = member(F.col("segment") - 1, before["bar_phase"], before["direction_state"])
    closes = before.isNotNull() & starts
    rows = (
        F.when(closes & (F.col("frame") == F.col("_last_frame")), F.array(shared))
        .when(closes, F.array(shared, own))
        .otherwise(F.array(own)))
    return runs.select(
        "clip_id", "frame", F.col("barbell_x_stable").alias("x"),
        F.col("barbell_y_stable").alias("y"), F.inline(rows),
    ).select(
        "clip_id", "segment", "frame", "x", "y", "bar_phase",
        phase_color(F.col("bar_phase")).alias("color"),
        phase_label(F.col("bar_phase")).alias("label"),
        F.when(F.col("direction_state") > 0, "up").otherwise("down").alias("direction"))


def bar_path_markers(analysis: DataFrame) -> DataFrame:
    """First and last point of each bar path that is drawn."""
    point = F.struct("frame", F.col("barbell_x_stable").alias("x"),
                     F.col("barbell_y_stable").alias("y"))
    ends = path_points(analysis).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(point, "frame").alias("start"), F.max_by(point, "frame").alias("end"),
    ).where(F.col("n") > MIN_PATH_POINTS)
    return ends.select(
        "clip_id",
        F.col("start.frame").alias("start_frame"), F.col("start.x").alias("start_x"),
        F.col("start.y").alias("start_y"),
        F.col("end.frame").alias("end_frame"), F.col("end.x").alias("end_x"),
        F.col("end.y").alias("end_y"))
