"""Technique faults from the phases, and what becomes of each clip's critique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.operators.phases import (
    BORDERS, PHASES, REQUIRED, identified, mark_borders,
)
from liftengine.plans.span import Whole
from liftengine.schema import FAULTS, require_columns

# fixed values: shares are of the frame height
KICK_SHARE = 0.05
JUMP_SHARE = 0.02
STRAIGHT_ARM_DEG = 160.0
DROP_SHARE = 0.05
DROP_SECONDS = 0.1
THIRD_PULL_SECONDS = 0.2
SINKING_PX_S = -10.0

# columns that the faults look at, besides those that the phases need
MEASURED = (
    "accel_y_smooth", "vel_y_smooth", "barbell_x_stable", "left_ankle_y", "right_ankle_y",
    "left_elbow_angle", "right_elbow_angle",
)
NO_PHASES = "Could not identify lift phases."
NO_FAULTS = "No faults detected."


def _between(a, b):
    return F.col("frame").between(F.col(f"_{a}")["frame"], F.col(f"_{b}")["frame"])


def clip_measures(analysis: DataFrame, span=Whole()) -> DataFrame:
    """One row per clip: border frames and times, and the measures the faults look at.

    A single pre-aggregated pass over the marked rows.
    """
    marked = mark_borders(
        require_columns(analysis, REQUIRED).select(
            "clip_id", "frame", *REQUIRED, *MEASURED), span)
    pull1, pull2, pull3, recovery = [_between(a, b) for _, a, b in PHASES]
    accel = F.col("accel_y_smooth")
    x = F.col("barbell_x_stable")
    ankle = F.coalesce(
        (F.col("left_ankle_y") + F.col("right_ankle_y")) / 2, "left_ankle_y", "right_ankle_y")
    at = {t: F.col("frame") == F.col(f"_{t}")["frame"] for t in BORDERS}
    # rows of the second pull are split in the middle, the odd one into the later half
    place = F.col("_row") - F.col("_t1")["_row"]
    half = F.floor((F.col("_t2")["_row"] - F.col("_t1")["_row"] + 1) / 2)
    hips_dropped = F.col("hip_y_avg") > (
        F.col("_t2")["hip"] + F.col("frame_height") * F.lit(DROP_SHARE))

    def seen(condition, value):
        return F.when(condition, value)

    return marked.groupBy("clip_id").agg(
        *[F.max(F.when(identified(), F.col(f"_{t}")["frame"])).alias(t) for t in BORDERS],
        *[F.max(F.when(identified(), F.col(f"_{t}")["time_s"])).alias(f"{t}_s") for t in BORDERS],
        F.max("frame_height").alias("frame_height"),
        F.avg(seen(pull1, accel)).alias("pull1_accel"),
        F.max(seen(at["t0"], x)).alias("start_x"),
        F.min(seen(pull1, x)).alias("min_x"),
        F.max(seen(pull1, x)).alias("max_x"),
        F.max(half).alias("pull2_half"),
        F.avg(seen(pull2, accel)).alias("pull2_accel"),
        F.avg(seen(pull2 & (place < half), accel)).alias("pull2_early_accel"),
        F.avg(seen(pull2 & (place >= half), accel)).alias("pull2_late_accel"),
        F.max(seen(at["t1"], ankle)).alias("start_ankle_y"),
        F.max(seen(at["t2"], ankle)).alias("end_ankle_y"),
        F.min(seen(pull2, F.least("left_elbow_angle", "right_elbow_angle"))).alias("min_elbow"),
        F.min(seen(pull3 & hips_dropped, F.struct("frame", "time_s"))).alias("_drop"),
        F.min(seen(recovery, F.col("vel_y_smooth"))).alias("recovery_min_speed"),
    ).withColumn("drop_s", F.col("_drop")["time_s"]).drop("_drop")


def fault_flags(measures: DataFrame, ankle_units: str = "as_is") -> DataFrame:
    """One boolean per fault code; a test on something missing is false.

    ``ankle_units="as_is"`` compares the ankles' normalised rise with pixels, which in
    practice never fires; ``"px"`` turns the rise into pixels first.
    """
    if ankle_units not in ("as_is", "px"):
        raise ValueError(f"ankle_units must be 'as_is' or 'px', not {ankle_units!r}")
    height = F.col("frame_height")
    rise = F.col("start_ankle_y") - F.col("end_ankle_y")
    if ankle_units == "px":
        rise = rise * height
    aside = F.greatest(
        F.abs(F.col("max_x") - F.col("start_x")), F.abs(F.col("min_x") - F.col("start_x")))
    tests = {
        "FP_SLOW": F.col("pull1_accel") <= 0,
        "FP_KICK": aside > height * F.lit(KICK_SHARE),
        "SP_HITCH": (F.col("pull2_half") > 0) & (
            F.coalesce(F.col("pull2_late_accel") < F.col("pull2_early_accel"), F.lit(False))
            | F.coalesce(F.col("pull2_accel") <= 0, F.lit(False))),
        "SP_JUMP": rise > height * F.lit(JUMP_SHARE),
        "SP_ARMS": F.col("min_elbow") < F.lit(STRAIGHT_ARM_DEG),
        "TP_STUCK": F.when(
            F.col("drop_s").isNotNull(), (F.col("drop_s") - F.col("t2_s")) > F.lit(DROP_SECONDS),
        ).otherwise((F.col("t3_s") - F.col("t2_s")) > F.lit(THIRD_PULL_SECONDS)),
        "RC_TIRING": F.col("recovery_min_speed") < F.lit(SINKING_PX_S),
    }
    found = F.col("t0").isNotNull()
    return measures.withColumns({
        code: F.coalesce(found & test, F.lit(False)) for code, test in tests.items()
    })


def route_lift_type(clips: DataFrame) -> DataFrame:
    """What is asked of each clip: faults for clean, only phases for others, none to skip."""
    lift = F.lower(F.coalesce("lift_type", F.lit("none")))
    return clips.select(
        "clip_id", lift.alias("lift_type"),
        F.when(lift == "none", "skip").when(lift == "clean", "faults").otherwise("phases")
        .alias("route"))


def phase_durations(measures: DataFrame) -> DataFrame:
    """Seconds per phase and in total; NULL when there are no phases."""
    spans = {f"{name}_s": (a, b) for name, a, b in PHASES} | {"total_s": ("t0", "t4")}
    return measures.withColumns({
        name: F.col(f"{b}_s") - F.col(f"{a}_s") for name, (a, b) in spans.items()})


def critique(
    analysis: DataFrame, clips: DataFrame, span=Whole(), ankle_units: str = "as_is",
) -> DataFrame:
    """One row per clip asked for: borders, durations, fault codes found, and status."""
    judged = phase_durations(fault_flags(clip_measures(analysis, span), ankle_units))
    asked = route_lift_type(clips).where("route <> 'skip'")
    checked = F.col("route") == "faults"
    codes = F.filter(
        F.array(*[F.when(checked & F.col(code), F.lit(code)) for code in FAULTS]),
        lambda code: code.isNotNull())
    found = F.col("t0").isNotNull()
    return asked.join(judged, "clip_id", "left").select(
        "clip_id", "lift_type", *BORDERS,
        *[f"{name}_s" for name, _, _ in PHASES], "total_s",
        codes.alias("fault_codes"),
        F.when(~found, "unidentified").otherwise("identified").alias("status"),
    )


def faults(critiqued: DataFrame) -> DataFrame:
    """One row per fault, numbered in the order of the checks."""
    names = list(FAULTS)
    return critiqued.select("clip_id", F.explode("fault_codes").alias("code")).select(
        "clip_id",
        F.array_position(F.array(*map(F.lit, names)), F.col("code")).cast("bigint").alias("ord"),
        "code",
        F.element_at(F.create_map(*[
            F.lit(text) for pair in FAULTS.items() for text in pair]), F.col("code"))
        .alias("message"))


def critique_status(critiqued: DataFrame) -> DataFrame:
    """Per clip: whether phases were found, how many faults, and the line that says so."""
    count = F.size("fault_codes").cast("bigint")
    return critiqued.select(
        "clip_id", "lift_type", "status", count.alias("n_faults"),
        F.when(F.col("status") == "unidentified", NO_PHASES)
        .when(count == 0, NO_FAULTS).otherwise("Faults detected.").alias("message"))
