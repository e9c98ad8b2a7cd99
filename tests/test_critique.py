"""Hand-made clips for phases, faults and the report."""

import pytest
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.operators import faults, phases, report
from liftengine.plans.span import Blocks, Whole
from tests.helpers import analysis, clip_table, rows_of

# A plain clean of 60 rows on a 1080 pixel frame.  The knees are at 0.7 * 1080 = 756.
#   rows  0-29  bar rests at 900, hips at 600
#   rows 30-39  the bar rises by 20 a row: below 878.4 from row 31, at the knees from row 37
#   rows 38-44  hips rise to 540 at row 44, bar goes on
#   rows 45-50  hips drop by 40 a row, lowest at row 50
#   rows 51-59  recovery to the top of the bar at row 59


def lift(**changes):
    rows = []
    for i in range(60):
        y = 900.0 if i < 30 else 900.0 - 20 * (i - 29)
        if i < 38:
            hip = 600.0
        elif i <= 44:
            hip = 600.0 - (i - 37) * 60 / 7
        elif i <= 50:
            hip = 540.0 + 40 * (i - 44)
        else:
            hip = 780.0 - 20 * (i - 50)
        row = {
            "barbell_y_stable": y, "hip_y_avg": hip, "left_ankle_y": 0.9, "right_ankle_y": 0.9,
            "left_elbow_angle": 175.0, "right_elbow_angle": 178.0,
            "accel_y_smooth": float(i),
        }
        rows.append(row)
    for columns, change in changes.items():
        for i, row in enumerate(rows):
            value = change(i, row)
            if value is not ...:
                row[columns] = value
    return rows


PLAIN_BORDERS = (31, 37, 44, 50, 59)


def borders(spark, clips, span=Whole()):
    return {r[0]: tuple(r[1:]) for r in phases.phases(analysis(spark, clips), span).collect()}


@pytest.mark.parametrize("span", [Whole(), Blocks(8)])
def test_borders(spark, span):
    got = borders(spark, {
        1: lift(),
        2: lift(barbell_y_stable=lambda i, r: 900.0),                     # never rises
        3: lift(left_knee_y=lambda i, r: -0.7),                           # never at the knees
        4: lift(barbell_y_stable=lambda i, r: None),                      # no bar
        5: lift(hip_y_avg=lambda i, r: None if i >= 37 else ...),         # hips lost after t1
        6: lift(left_knee_y=lambda i, r: None if i < 40 else ...),        # one knee missing
        7: lift(hip_y_avg=lambda i, r: 550.0 if i >= 37 else ...),        # ties: the first
    }, span)
    none = (None,) * 5
    assert got == {1: PLAIN_BORDERS, 2: none, 3: none, 4: none, 5: none,
                   6: (31, 40, 44, 50, 59), 7: (31, 37, 37, 37, 59)}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Missing columns hip_y_avg, time_s"):
        phases.phases(analysis(spark, {1: lift()}).drop("hip_y_avg", "time_s"))


def test_slices_share_their_borders(spark):
    table = analysis(spark, {1: lift()})
    got = rows_of(phases.phase_slices(table, phases.phases(table)).groupBy("phase").agg(
        F.min("frame"), F.max("frame"), F.count("frame")))
    assert got == [("first_pull", 31, 37, 7), ("recovery", 50, 59, 10),
                   ("second_pull", 37, 44, 8), ("third_pull", 44, 50, 7)]


CASES = {
    # a plain lift: hips drop past 5 % (54 px) in two rows
    "plain": (lift(), []),
    "slowing": (lift(accel_y_smooth=lambda i, r: -1.0 if i <= 36 else (6.0 if i == 37 else ...)),
                ["FP_SLOW"]),
    "slowing_unknown": (lift(accel_y_smooth=lambda i, r: None if i <= 37 else ...), []),
    "kick": (lift(barbell_x_stable=lambda i, r: 554.5 if i == 34 else ...), ["FP_KICK"]),
    "kick_within": (lift(barbell_x_stable=lambda i, r: 554.0 if i == 34 else ...), []),
    "kick_start_unknown": (lift(barbell_x_stable=lambda i, r: None if i == 31 else (
        700.0 if i == 34 else ...)), []),
    # eight rows 37-44: later half 41-44
    "hitch": (lift(accel_y_smooth=lambda i, r: 1.0 if 41 <= i <= 44 else ...), ["SP_HITCH"]),
    "hitch_negative": (lift(accel_y_smooth=lambda i, r: -9.0 + (i - 37) if 37 <= i <= 44 else (
        99.0 if i <= 36 else ...)), ["SP_HITCH"]),
    "jump": (lift(left_ankle_y=lambda i, r: 0.87 if i >= 44 else ...,
                  right_ankle_y=lambda i, r: 0.87 if i >= 44 else ...), []),
    "arms": (lift(right_elbow_angle=lambda i, r: 159.9 if i == 40 else ...), ["SP_ARMS"]),
    "arms_other_missing": (lift(left_elbow_angle=lambda i, r: None,
                                right_elbow_angle=lambda i, r: 150.0 if i == 40 else ...),
                           ["SP_ARMS"]),
    "arms_outside": (lift(right_elbow_angle=lambda i, r: 90.0 if i in (36, 45) else ...), []),
    # the drop past 594 comes four rows after t2
    "stuck": (lift(hip_y_avg=lambda i, r: 541.0 if 45 <= i <= 47 else ...), ["TP_STUCK"]),
    # never drops that far: shallow, over ten rows (0.33 s) or five (0.17 s)
    "stuck_shallow": (lift(hip_y_avg=lambda i, r: 540.0 + min(i - 44, 10) if i >= 44 else ...),
                      ["TP_STUCK"]),
    "shallow_quick": (lift(hip_y_avg=lambda i, r: 540.0 + min(i - 44, 5) if i >= 44 else ...), []),
    "tiring": (lift(vel_y_smooth=lambda i, r: -10.5 if i == 55 else ...), ["RC_TIRING"]),
    "tiring_within": (lift(vel_y_smooth=lambda i, r: -10.0 if i >= 50 else ...), []),
    # the second pull is a single row
    "single_row": (lift(hip_y_avg=lambda i, r: 500.0 if i == 37 else (
        700.0 if i == 38 else (500.5 if i > 38 else ...)),
        accel_y_smooth=lambda i, r: -99.0 if i == 37 else (900.0 if i < 37 else ...)), []),
}


@pytest.fixture(scope="module")
def judged(spark):
    clips = {i: rows for i, (rows, _) in enumerate(CASES.values())}
    return analysis(spark, clips).cache(), clip_table(spark, list(clips))


@pytest.mark.parametrize("span", [Whole(), Blocks(8)])
def test_faults(judged, span):
    table, clips = judged
    got = {r["clip_id"]: r["fault_codes"] for r in faults.critique(table, clips, span).collect()}
    assert {name: got[i] for i, name in enumerate(CASES)} == {
        name: codes for name, (_, codes) in CASES.items()}


def test_ankles_in_pixels(judged):
    table, clips = judged
    number = list(CASES).index("jump")
    got = {r["clip_id"]: r["fault_codes"]
           for r in faults.critique(table, clips, ankle_units="px").collect()}
    assert got[number] == ["SP_JUMP"]
    assert sum("SP_JUMP" in codes for codes in got.values()) == 1
    with pytest.raises(ValueError, match="ankle_units"):
        faults.fault_flags(table, "feet")


def test_fault_rows_are_in_order(spark):
    rows = lift(vel_y_smooth=lambda i, r: -11.0 if i == 55 else ...,
                barbell_x_stable=lambda i, r: 700.0 if i == 34 else ...)
    found = faults.faults(faults.critique(analysis(spark, {1: rows}), clip_table(spark, [1])))
    assert rows_of(found.select("ord", "code", "message")) == [
        (2, "FP_KICK", schema.FAULTS["FP_KICK"]), (7, "RC_TIRING", schema.FAULTS["RC_TIRING"])]


def test_routes_and_status(spark):
    kicked = lift(barbell_x_stable=lambda i, r: 700.0 if i == 34 else ...)
    table = analysis(spark, {1: kicked, 2: kicked, 3: kicked, 4: lift(), 5: [{}], 7: kicked})
    clips = clip_table(spark, [1, 4, 5, 6]).unionByName(clip_table(spark, [2], "snatch")) \
        .unionByName(clip_table(spark, [3], "none")).unionByName(clip_table(spark, [7], None))
    routes = {r[0]: r[2] for r in faults.route_lift_type(clips).collect()}
    assert routes == {1: "faults", 2: "phases", 3: "skip", 4: "faults", 5: "faults", 6: "faults",
                      7: "skip"}
    status = faults.critique_status(faults.critique(table, clips))
    assert rows_of(status, "clip_id") == [
        (1, "clean", "identified", 1, "Faults detected."),
        (2, "snatch", "identified", 0, faults.NO_FAULTS),
        (4, "clean", "identified", 0, faults.NO_FAULTS),
        (5, "clean", "unidentified", 0, faults.NO_PHASES),
        (6, "clean", "unidentified", 0, faults.NO_PHASES),
    ]


REPORT = """# Analysis Report: {}

## Phase Timing
- **First Pull:**  0.20s
- **Second Pull:** 0.23s
- **Third Pull:**  0.20s
- **Recovery:**    0.30s
- **Total Time:**  0.93s

## Critique
{}"""


def test_report(spark):
    bent = lift(left_elbow_angle=lambda i, r: 90.0,
                vel_y_smooth=lambda i, r: -11.0 if i == 55 else ...)
    table = analysis(spark, {1: bent, 2: lift(), 3: bent, 4: [{}]})
    clips = clip_table(spark, [1, 2, 4]).unionByName(clip_table(spark, [3], "snatch"))
    got = dict(rows_of(report.report_markdown(faults.critique(table, clips))))
    lines = "\n".join(f"- {schema.FAULTS[c]}" for c in ("SP_ARMS", "RC_TIRING"))
    assert got == {
        1: REPORT.format("Clean", lines),
        2: REPORT.format("Clean", report.NO_MAJOR_FAULTS),
        3: REPORT.format("Snatch", report.NO_MAJOR_FAULTS),
    }


def test_shuffles_of_the_faults(spark, small):
    """Windows, pose join and the pass over clips share their exchanges by clip."""
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["faults"](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # user_id numbers the fixture's events; the others are the engine's
    assert len([k for k in keys if k != "user_id"]) <= 3
