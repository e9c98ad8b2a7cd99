"""Choosing the barbell among the detections of each frame, and camera shake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.functions.geometry import mean_present, to_pixels
from liftengine.operators.pose import landmark_rows
from liftengine.plans.span import BLOCK, Previous, Whole, join_frames
from liftengine.sources.scratch import write_scratch

BOX = ("x1", "y1", "x2", "y2")
# frames folded into one list before it is set aside; keeps appending cheap
FOLD_CHUNK = 256


def is_wanted(
    class_name: str = "endcap", conf: float = schema.MIN_CONFIDENCE,
    names: dict[int, str] | None = None,
) -> Column:
    """Whether a detection is of the wanted class and sure enough.

    ``names`` are the detector's class names by id.  A class it does not know stands for
    the class with id 0; ids without a name match if they are 0.
    """
    names = names or {}
    target = class_name if class_name in names.values() else names.get(0)
    named = [i for i, name in names.items()]
    wanted = [i for i, name in names.items() if name == target]
    if 0 not in named:
        wanted.append(0)
    return F.col("class_id").isin(wanted) & (F.col("conf") >= conf)


def filter_detections(
    det: DataFrame, class_name: str = "endcap", conf: float = schema.MIN_CONFIDENCE,
    names: dict[int, str] | None = None,
) -> DataFrame:
    """Detections of the wanted class that are sure enough (see `is_wanted`)."""
    return det.where(is_wanted(class_name, conf, names))


def clamp_boxes(det: DataFrame, clips: DataFrame, span=Whole()) -> DataFrame:
    """Boxes cut to the frame, with whole-pixel centre; ``clips`` has its defaults."""
    sized = span.attach(det, clips.select("clip_id", "frame_width", "frame_height"))
    limit = {"x1": "frame_width", "x2": "frame_width", "y1": "frame_height", "y2": "frame_height"}
    inside = sized.withColumns({
        side: F.when(F.col(side).isNotNull(), F.greatest(
            F.lit(0.0), F.least(F.col(side), F.col(size) - F.lit(1.0))))
        for side, size in limit.items()
    })
    return inside.withColumns({
        "cx": F.floor((F.col("x1") + F.col("x2")) / 2),
        "cy": F.floor((F.col("y1") + F.col("y2")) / 2),
    })


def feet_position(landmarks: DataFrame, clips: DataFrame, span=Whole()) -> DataFrame:
    """Per frame, mean pixel position of the ankles seen well enough; NULL if none."""
    seen = F.col("vis") > schema.FEET_GATE
    ankles = landmarks.where(F.col("landmark").isin("left_ankle", "right_ankle"))
    wide = ankles.groupBy("clip_id", "frame").agg(*[
        F.max(F.when((F.col("landmark") == f"{side}_ankle") & seen, F.col(part)))
        .alias(f"{side}_{part}")
        for side in ("left", "right") for part in ("x", "y")
    ])
    sized = span.attach(wide, clips.select("clip_id", "frame_width", "frame_height"))
    left = to_pixels(F.col("left_x"), F.col("left_y"), F.col("frame_width"), F.col("frame_height"))
    right = to_pixels(
        F.col("right_x"), F.col("right_y"), F.col("frame_width"), F.col("frame_height"))
    return sized.select(
        "clip_id", "frame",
        mean_present(left[0], right[0]).alias("feet_x"),
        mean_present(left[1], right[1]).alias("feet_y"))


def candidates(clamped: DataFrame, feet: DataFrame) -> DataFrame:
    """Detections with ``first_key``, by which the first frame's choice is made.

    Squared distance to the feet, or distance from the middle if no foot is seen.
    """
    near_feet = (
        (F.col("cx") - F.col("feet_x")) * (F.col("cx") - F.col("feet_x"))
        + (F.col("cy") - F.col("feet_y")) * (F.col("cy") - F.col("feet_y")))
    near_middle = F.abs(F.col("cx") - F.col("frame_width") / 2)
    return join_frames(clamped, feet).select(
        "clip_id", "frame", "det_id",
        F.coalesce(near_feet, near_middle).alias("first_key"),
        F.when(F.col("feet_x").isNotNull(), "feet").otherwise("center").alias("chosen_by"),
        "cx", "cy", *BOX)


def initial_endcap(cands: DataFrame) -> DataFrame:
    """Per clip, the detection that starts the track, in the first frame with any."""
    chosen = F.min(F.struct("frame", "first_key", "det_id", "chosen_by", "cx", "cy", *BOX))
    return cands.groupBy("clip_id").agg(chosen.alias("c")).select(
        "clip_id", "c.frame", "c.det_id", "c.chosen_by", "c.cx", "c.cy", *[f"c.{s}" for s in BOX])


# --- following the chosen detection from frame to frame -------------------------

def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _pick(options: Column, state: Column) -> Column:
    """The option nearest to the state's centre, or first by ``first_key`` without one."""
    def keyed(c):
        dx, dy = c["cx"] - state["sx"], c["cy"] - state["sy"]
        distance = F.coalesce((dx * dx + dy * dy).cast("double"), c["first_key"])
        return F.struct(distance.alias("d"), c["det_id"].alias("det_id"), c.alias("c"))

    return F.array_min(F.transform(options, keyed))["c"]


def _state(sx, sy) -> Column:
    return F.struct(sx.cast("bigint").alias("sx"), sy.cast("bigint").alias("sy"))


def _no_state() -> Column:
    return _state(F.lit(None), F.lit(None))


def _follow(steps: Column, start: Column, note, leave, note_type: str) -> Column:
    """Fold over ``steps`` (structs with ``options``), noting each choice.

    ``note(step, choice)`` is what is kept of a choice and ``leave(choice)`` the centre
    that the next step compares with.  Choices are listed per chunk of steps, so that
    appending never copies a long list.
    """
    def empty(kind):
        return F.array().cast(kind)

    def acc(sx, sy, out):
        return F.struct(
            sx.cast("bigint").alias("sx"), sy.cast("bigint").alias("sy"), out.alias("out"))

    def one(a, step):
        return _bind(_pick(step["options"], a), lambda c: acc(
            *leave(c), F.concat(a["out"], F.array(note(step, c)))))

    def chunk(a, part):
        return F.aggregate(
            part, acc(a["sx"], a["sy"], empty(f"array<{note_type}>")), one,
            lambda r: acc(r["sx"], r["sy"], F.concat(a["out"], F.array(r["out"]))))

    parts = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLD_CHUNK).cast("int")),
        lambda i: F.slice(steps, i * FOLD_CHUNK + 1, F.lit(FOLD_CHUNK))))
    parts = F.coalesce(parts, F.slice(F.array(steps), 1, 0))
    return F.flatten(F.aggregate(
        parts, acc(start["sx"], start["sy"], empty(f"array<array<{note_type}>>")), chunk,
        lambda r: r["out"]))


_CHOICE = ("det_id", "cx", "cy", *BOX)
_CHOICE_TYPE = ("struct<frame:bigint,det_id:bigint,cx:bigint,cy:bigint,"
                "x1:double,y1:double,x2:double,y2:double>")


def _choice(frame, c) -> Column:
    return F.struct(frame.alias("frame"), *[c[name].alias(name) for name in _CHOICE])


def _center(c):
    return c["cx"], c["cy"]


def _steps_by_frame(cands: DataFrame) -> DataFrame:
    option = F.struct("det_id", "first_key", "cx", "cy", *BOX)
    return cands.groupBy("clip_id", "frame").agg(
        F.sort_array(F.collect_list(option)).alias("options"))


def _ordered_steps():
    return F.sort_array(F.collect_list(F.struct("frame", "options"))).alias("steps")


def track_endcap(cands: DataFrame, span=Whole()) -> DataFrame:
    """The chosen detection of every frame that has one.

    Each choice depends on the one before, so a clip is folded in frame order.  Long
    clips are cut into blocks: every block is folded once from each option of its first
    frame, outcomes are composed over groups of blocks, groups of groups and so on, and
    only then the blocks' own choices are written out.
    """
    frames = _steps_by_frame(cands)
    if isinstance(span, Whole):
        steps = frames.groupBy("clip_id").agg(_ordered_steps())
        path = _follow(F.col("steps"), _no_state(),
                       lambda step, c: _choice(step["frame"], c), _center, _CHOICE_TYPE)
    else:
        steps = _blocked_steps(frames, span)
        first, rest = F.col("steps")[0], F.slice("steps", 2, F.size("steps"))
        entry = F.filter(first["options"], lambda c: c["det_id"] == F.col("_entry"))[0]
        path = F.concat(
            F.array(_choice(first["frame"], entry)),
            _follow(rest, _state(entry["cx"], entry["cy"]),
                    lambda step, c: _choice(step["frame"], c), _center, _CHOICE_TYPE))
    return steps.select("clip_id", F.inline(path))


def _summed_up(groups: DataFrame, leave) -> DataFrame:
    """Per group of steps, the options of its first step with the centre that each leads to.

    ``leave(option)`` is the centre after an option of a single step.
    """
    rest = F.slice("steps", 2, F.size("steps"))

    def outcome(c):
        left = F.aggregate(
            rest, _state(*leave(c)),
            lambda s, step: _bind(_pick(step["options"], s), lambda p: _state(*leave(p))))
        return _bind(left, lambda s: F.struct(
            *[c[name].alias(name) for name in ("det_id", "first_key", "cx", "cy")],
            s["sx"].alias("lx"), s["sy"].alias("ly")))

    return groups.select(
        "clip_id", BLOCK, F.transform(F.col("steps")[0]["options"], outcome).alias("options"))


def _left(c):
    return c["lx"], c["ly"]


def _blocked_steps(frames: DataFrame, span) -> DataFrame:
    """Steps per block of a clip, with the entry choice that the earlier blocks lead to.

    An option's way through a block is a map from options to centres, and such maps compose.
    So blocks are grouped by ``fold_fan``, each group becomes one step of the level above, and
    so on until a clip is one group.  Its first choice then goes down again, level by level.
    No row holds more than ``fold_fan`` blocks or ``fold_size`` frames.
    """
    cut = frames.withColumn(BLOCK, F.floor(F.col("frame") / F.lit(span.fold_size)).cast("bigint"))
    blocks = write_scratch(cut.groupBy("clip_id", BLOCK).agg(_ordered_steps()))
    summary, groups = write_scratch(_summed_up(blocks, _center)), []
    highest = blocks.agg(F.max(BLOCK)).first()[0] or 0
    while highest:
        up = F.floor(F.col(BLOCK) / span.fold_fan).cast("bigint")
        groups.append(write_scratch(summary.groupBy("clip_id", up.alias("_up")).agg(
            F.sort_array(F.collect_list(F.struct(BLOCK, "options"))).alias("steps")
        ).withColumnRenamed("_up", BLOCK)))
        summary = write_scratch(_summed_up(groups[-1], _left))
        highest //= span.fold_fan
    first = _pick(F.col("options"), _no_state())
    entries = summary.select("clip_id", BLOCK, first["det_id"].alias("_entry"))
    for group in reversed(groups):
        head, rest = F.col("steps")[0], F.slice("steps", 2, F.size("steps"))
        entry = F.filter(head["options"], lambda c: c["det_id"] == F.col("_entry"))[0]

        def note(step, c):
            return F.struct(step[BLOCK].alias("_child"), c["det_id"].alias("_entry"))

        chosen = F.concat(F.array(note(head, entry)), _follow(
            rest, _state(*_left(entry)), note, _left, "struct<_child:bigint,_entry:bigint>"))
        entries = group.join(entries, ["clip_id", BLOCK]).select(
            "clip_id", F.inline(chosen)).withColumnRenamed("_child", BLOCK)
    return blocks.join(entries, ["clip_id", BLOCK])


# --- shake -----------------------------------------------------------------------

def estimate_shake(frames: DataFrame, flow: DataFrame, span=Whole()) -> DataFrame:
    """Per frame, the median movement of the tracked features.

    0 where at most five features are tracked, and on a clip's first frame.
    """
    tracked = flow.where("status = 1").groupBy("clip_id", "frame").agg(
        F.count(F.lit(1)).alias("features"),
        F.median("dx").alias("mx"), F.median("dy").alias("my"))
    enough = F.col("features") > schema.MIN_FLOW_FEATURES
    placed = span.derive(
        frames.select("clip_id", "frame"), _prev_frame=Previous(F.col("frame")))
    later = F.col("_prev_frame").isNotNull()
    return join_frames(placed, tracked).select(
        "clip_id", "frame",
        F.coalesce(F.when(enough & later, F.col("mx")), F.lit(0.0)).alias("shake_dx"),
        F.coalesce(F.when(enough & later, F.col("my")), F.lit(0.0)).alias("shake_dy"))


def collect_frames(
    frames: DataFrame, clips: DataFrame, detections: DataFrame,
    landmarks: DataFrame | None = None, flow: DataFrame | None = None,
    class_name: str = "endcap", names: dict[int, str] | None = None, span=Whole(), counts=None,
) -> DataFrame:
    """Frame table from the long tables: chosen bar, its box, and shake on every frame.

    Without ``landmarks`` the frames' own landmark maps are used and kept; without
    ``flow`` the camera counts as still.  ``counts`` are told how many chosen detections
    belong to no frame.
    """
    own_maps = landmarks is None
    rows = landmark_rows(frames) if own_maps else landmarks
    wanted = clamp_boxes(filter_detections(detections, class_name, names=names), clips, span)
    track = track_endcap(candidates(wanted, feet_position(rows, clips, span)), span)
    bar = track.select(
        "clip_id", "frame",
        F.col("cx").cast("double").alias("barbell_x_raw"),
        F.col("cy").cast("double").alias("barbell_y_raw"),
        *[F.col(side).alias(f"box_{side}") for side in BOX])
    if flow is None:
        shaken = frames.select(
            "clip_id", "frame", F.lit(0.0).alias("shake_dx"), F.lit(0.0).alias("shake_dy"))
    else:
        shaken = estimate_shake(frames, flow, span)
    if counts:
        marked = join_frames(shaken.withColumn("_framed", F.lit(True)), bar, "full")
        collected = counts.watch(
            marked, "tracked", orphan_detections=F.col("_framed").isNull()).where(
            "_framed").drop("_framed")
    else:
        collected = join_frames(shaken, bar)
    if own_maps:
        collected = join_frames(collected, frames.select("clip_id", "frame", "landmarks"))
    return collected
