"""What a renderer draws on each frame, as a table of primitives.

The bar trail of a frame is every earlier path segment moved by that frame's shake.
Written out for all frames this grows with the square of a clip's length, so it is kept
in two linear tables: the segments, each with the frame it appears on, and per frame the
shift and the number of points in sight.

For drawing, `trail_pieces` cuts the path into polylines of 1, 2, 4, ... segments, and
`frame_pieces` says of which few a frame's trail consists: one for every digit 1 of its
number of segments in binary, and a run of the longest.  So all frames of a clip need
n log n references and as many stored segments.  `trail_on_frames` joins the two into whole
pixels for the frames one wants to draw; its size is what is asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftengine.functions.geometry import body_part, to_pixels, truncate
from liftengine.functions.text import fixed, text_to_box
from liftengine.operators.charts import path_points, phase_color
from liftengine.plans.span import LastKnown, Previous, RunningSum, Whole, join_frames
from liftengine.schema import LANDMARKS, SKELETON_EDGES
from liftengine.sources.tracks import clip_defaults


# the longest polyline has 2 to the power of this many segments
TOP = 10
# what is read of the analysis: for the shift of frames and the trail, for the whole state of
# frames, and for all primitives
ON_PATH = ("barbell_x_stable", "barbell_y_stable")
SHIFTED = ("clip_id", "frame", *ON_PATH, "total_shake_x", "total_shake_y", "bar_phase")
STATED = (*SHIFTED, "lifter_angle_deg", "time_s")
DRAWN = (*STATED, "frame_width", "frame_height", "barbell_box_str",
         *[f"{name}_{axis}" for name in LANDMARKS for axis in ("x", "y")])


def render_plan(analysis: DataFrame, clips: DataFrame, span=Whole()) -> DataFrame:
    """The frames to draw: up to a second after the last analysed one, or the clip's end."""
    on_path = F.col("barbell_x_stable").isNotNull() & F.col("barbell_y_stable").isNotNull()
    reach = analysis.groupBy("clip_id").agg(
        F.max("frame").alias("last_frame"), F.count_if(on_path).alias("all_points"))
    per_clip = clip_defaults(clips).join(reach, "clip_id", "left")
    count = F.least(
        F.coalesce("last_frame", F.lit(0)) + F.floor("fps"), F.col("total_frames"))
    planned = per_clip.select(
        "clip_id", "fps", F.coalesce("all_points", F.lit(0)).alias("all_points"),
        count.alias("frames_to_render"))
    return span.spread(planned, F.col("frames_to_render"), "frame")


def _carried(plan, analysis, span, *others, **needs):
    """The drawn frames with what is known of them and what earlier frames leave, and the shift."""
    known = analysis.select(
        "clip_id", "frame", "total_shake_x", "total_shake_y", *others,
        (F.col("barbell_x_stable").isNotNull() & F.col("barbell_y_stable").isNotNull())
        .alias("_on_path"))
    carried = span.derive(
        join_frames(plan, known),
        _shake=LastKnown(F.when(
            F.col("total_shake_x").isNotNull(),
            F.struct(F.col("total_shake_x").alias("x"), F.col("total_shake_y").alias("y")))),
        _points=RunningSum(F.coalesce("_on_path", F.lit(False)).cast("bigint")),
        **needs)
    analysed = F.col("_on_path").isNotNull()
    return carried.withColumns({
        "analysed": analysed,
        "shake_x": F.coalesce(F.col("_shake")["x"], F.lit(0.0)),
        "shake_y": F.coalesce(F.col("_shake")["y"], F.lit(0.0)),
        "path_points": F.when(analysed, F.col("_points")).otherwise(F.col("all_points")),
    })


def frame_shift(plan: DataFrame, analysis: DataFrame, span=Whole()) -> DataFrame:
    """Per drawn frame the shake and the path points in sight: all that a trail needs."""
    return _carried(plan, analysis, span).select(
        "clip_id", "frame", "shake_x", "shake_y", "path_points")


def frame_state(plan: DataFrame, analysis: DataFrame, span=Whole()) -> DataFrame:
    """Per drawn frame: shake, lifter angle, time, and path points in sight.

    Frames without an analysed row keep the last shake and angle and show the full path.
    """
    carried = _carried(plan, analysis, span, "lifter_angle_deg", "time_s",
                       _angle=LastKnown(F.col("lifter_angle_deg")))
    analysed = F.col("analysed")
    return carried.select(
        "clip_id", "frame", "analysed", "shake_x", "shake_y",
        F.when(analysed, F.col("lifter_angle_deg")).otherwise(F.col("_angle"))
        .alias("lifter_angle_deg"),
        F.when(analysed, F.col("time_s")).otherwise(F.col("frame") / F.col("fps"))
        .alias("time_s"),
        "path_points")


def path_trail(analysis: DataFrame, span=Whole()) -> DataFrame:
    """Segments of the stabilised path, coloured by the phase they start in.

    ``frame`` is the first analysed frame that shows the segment; a frame shows those
    with ``segment < path_points``.
    """
    points = path_points(analysis).select(
        "clip_id", "frame", F.col("barbell_x_stable").alias("x"),
        F.col("barbell_y_stable").alias("y"), "bar_phase")
    linked = span.derive(
        points, _from=Previous(F.struct("x", "y", "bar_phase")), _point=RunningSum(F.lit(1)))
    start = F.col("_from")
    return linked.where(start.isNotNull()).select(
        "clip_id", (F.col("_point") - 1).cast("bigint").alias("segment"), "frame",
        start["x"].alias("x1"), start["y"].alias("y1"),
        F.col("x").alias("x2"), F.col("y").alias("y2"),
        phase_color(start["bar_phase"]).alias("color"))


def last_states(states: DataFrame) -> DataFrame:
    """The state of each clip's last drawn frame."""
    fields = ("frame", "shake_x", "shake_y", "path_points")
    return states.groupBy("clip_id").agg(
        F.max_by(F.struct(*fields), "frame").alias("s")).select(
        "clip_id", *[f"s.{name}" for name in fields])


def trail_pieces(trail: DataFrame, top: int = TOP) -> DataFrame:
    """Polylines (clip_id, level, number, segments): ``number`` counts runs of 2^level segments.

    Segments are gathered once, in runs of the longest length; shorter pieces are cut from
    these within the row.  The unfinished run at the end of a clip has its shorter pieces only.
    """
    fields = F.struct("segment", "x1", "y1", "x2", "y2", "color")
    runs = trail.groupBy(
        "clip_id", F.shiftright(F.col("segment") - 1, top).alias("_run")).agg(
        F.sort_array(F.collect_list(fields)).alias("_all"))

    def cut(level):
        count = F.shiftright(F.size("_all"), level)
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda j: j < count),
            lambda j: F.struct(
                F.lit(level).alias("level"),
                (F.shiftleft("_run", top - level) + j).alias("number"),
                F.slice("_all", j * (1 << level) + 1, F.lit(1 << level)).alias("segments")))

    return runs.select("clip_id", F.inline(F.flatten(F.array(*[cut(k) for k in range(top + 1)]))))


def frame_pieces(states: DataFrame, top: int = TOP) -> DataFrame:
    """The polylines of each frame's trail, with the frame's shift.

    ``count`` polylines of ``level`` from ``number`` on; only the longest come in runs.
    """
    length = F.greatest(F.col("path_points") - 1, F.lit(0))
    digits = [F.when(
        F.shiftright(length, level) % 2 == 1, F.struct(
            F.lit(level).alias("level"), (F.shiftright(length, level) - 1).alias("number"),
            F.lit(1).cast("bigint").alias("count"))) for level in range(top)]
    longest = F.shiftright(length, top)
    digits.append(F.when(longest > 0, F.struct(
        F.lit(top).alias("level"), F.lit(0).cast("bigint").alias("number"),
        longest.alias("count"))))
    return states.select("clip_id", "frame", "shake_x", "shake_y", F.inline(
        F.filter(F.array(*digits), lambda d: d.isNotNull())))


def trail_on_frames(trail: DataFrame, states: DataFrame, span=Whole(), top: int = TOP):
    """The trail in whole pixels on the frames of ``states`` (rows of `frame_state`)."""
    wanted = span.spread(frame_pieces(states, top), F.col("count"), "_nth").withColumn(
        "number", F.col("number") + F.col("_nth"))
    drawn = wanted.join(trail_pieces(trail, top), ["clip_id", "level", "number"])
    return drawn.select(
        "clip_id", "frame", "shake_x", "shake_y", F.inline("segments")).select(
        "clip_id", "frame", "segment", "color",
        *[truncate(F.col(c) + F.col(f"shake_{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _box() -> Column:
    """The barbell box, from its text."""
    return text_to_box(F.col("barbell_box_str"))


def box_primitives(analysis: DataFrame) -> DataFrame:
    """The barbell box of each analysed frame that has one."""
    return analysis.select("clip_id", "frame", _box().alias("b")).where("b IS NOT NULL").select(
        "clip_id", "frame", F.lit("Barbell Box").alias("color"), "b.x1", "b.y1", "b.x2", "b.y2")


def _pixel(name):
    x, y = to_pixels(F.col(f"{name}_x"), F.col(f"{name}_y"),
                     F.col("frame_width"), F.col("frame_height"))
    return truncate(x), truncate(y)


def _edges() -> list[tuple]:
    """(color, x1, y1, x2, y2) of the twelve candidates within a row."""
    return [(F.lit(body_part(a, b)), *_pixel(a), *_pixel(b)) for a, b in SKELETON_EDGES]


def skeleton_edges(analysis: DataFrame) -> DataFrame:
    """Body edges with both ends in sight: no join."""
    edges = [
        F.struct(F.lit(number).cast("bigint").alias("edge"), color.alias("color"),
                 x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        for number, (color, x1, y1, x2, y2) in enumerate(_edges())]
    return analysis.select("clip_id", "frame", F.inline(F.array(*edges))).where(
        "x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")


def joint_points(analysis: DataFrame) -> DataFrame:
    """Landmarks in sight, in whole pixels."""
    joints = []
    for name in LANDMARKS:
        x, y = _pixel(name)
        joints.append(F.struct(F.lit(name).alias("landmark"), x.alias("x1"), y.alias("y1")))
    return analysis.select("clip_id", "frame", F.inline(F.array(*joints))).where(
        "x1 IS NOT NULL AND y1 IS NOT NULL")


def _captions() -> dict[str, Column]:
    """The text lines of a drawn frame (fixed texts); NULL where the angle is unknown."""
    return {
        "angle": F.concat(F.lit("Lifter Angle: "), fixed(F.col("lifter_angle_deg"), 1),
                          F.lit(" deg")),
        "time": F.concat(F.lit("Time: "), fixed(F.col("time_s"), 2), F.lit("s")),
        "frame": F.concat(F.lit("Frame: "), F.col("frame").cast("string")),
    }


def captions(states: DataFrame) -> DataFrame:
    """Text lines of each drawn frame; no angle line where the angle is unknown."""
    lines = F.array(*[
        F.struct(F.lit(name).alias("caption"), text.alias("text"),
                 (F.col("lifter_angle_deg").isNotNull() if name == "angle" else F.lit(True))
                 .alias("shown"))
        for name, text in _captions().items()])
    return states.select("clip_id", "frame", F.inline(lines)).where("shown").drop("shown")


def _primitive(kind, color=None, x1=None, y1=None, x2=None, y2=None, text=None, shown=None):
    """One primitive as a struct; NULL where it is not shown."""
    fields = {"color": (color, "string"), "x1": (x1, "double"), "y1": (y1, "double"),
              "x2": (x2, "double"), "y2": (y2, "double"), "text": (text, "string")}
    made = F.struct(F.lit(kind).alias("kind"), *[
        (F.lit(None) if value is None else value).cast(form).alias(name)
        for name, (value, form) in fields.items()])
    return made if shown is None else F.when(shown, made)


def overlay(analysis: DataFrame, clips: DataFrame, span=Whole()) -> DataFrame:
    """All primitives as (clip, frame, kind, color, x1, y1, x2, y2, text).

    ``trail`` rows hold stabilised coordinates from the frame they appear on; the ``shift``
    row of a frame says by how much to move them and how many points it shows.
    """
    states = frame_state(render_plan(analysis, clips, span), analysis, span).select(
        "*", F.lit(True).alias("_drawn"))
    points = [f"{name}_{axis}" for name in LANDMARKS for axis in ("x", "y")]
    rows = join_frames(states, analysis.select(
        "clip_id", "frame", "frame_width", "frame_height", "barbell_box_str", *points), "full")
    drawn, white = F.col("_drawn").isNotNull(), F.lit("White")

    def seen(*values):
        return functools.reduce(lambda a, b: a & b, [v.isNotNull() for v in values])

    box = F.col("_box")
    parts = [
        _primitive("shift", x1=F.col("shake_x"), y1=F.col("shake_y"),
                   text=F.col("path_points").cast("string"), shown=drawn),
        _primitive("box", F.lit("Barbell Box"), box["x1"], box["y1"], box["x2"], box["y2"],
                   shown=box.isNotNull()),
        *[_primitive("edge", *edge, shown=seen(*edge[1:])) for edge in _edges()],
        *[_primitive("joint", white, *_pixel(name), text=F.lit(name), shown=seen(*_pixel(name)))
          for name in LANDMARKS],
        *[_primitive("caption", white, text=text, shown=drawn & (
            F.col("lifter_angle_deg").isNotNull() if name == "angle" else F.lit(True)))
          for name, text in _captions().items()],
    ]
    framed = rows.withColumn("_box", _box()).select(
        "clip_id", "frame", F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    trail = path_trail(analysis, span).select(
        "clip_id", "frame", F.lit("trail").alias("kind"), "color",
        *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.lit(None).cast("string").alias("text"))
    return framed.unionByName(trail)
