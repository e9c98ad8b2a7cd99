"""Chart tables, bar path segments and overlay primitives on hand-made clips."""

import pytest
from pyspark.sql import functions as F

from liftengine.operators import charts, overlay
from liftengine.plans.span import Blocks, Whole
from liftengine.schema import CHART_TITLES, PATH_CHART_TITLE
from tests.helpers import analysis, clip_table, rows_of

SPANS = [Whole(), Blocks(3)]


def path(phases, **more):
    """One row per phase number; None leaves the bar out."""
    return [
        {"barbell_x_stable": None if p is None else 100.0 + i,
         "barbell_y_stable": None if p is None else 900.0 - i,
         "bar_phase": p or 1, "direction_state": 1.0 if (p or 1) % 2 else -1.0,
         "total_shake_x": 0.5 * i, "total_shake_y": -0.5 * i} | more
        for i, p in enumerate(phases)
    ]


@pytest.mark.parametrize("span", SPANS)
def test_segments(spark, span):
    table = analysis(spark, {
        1: path([1, 1, 2, 2, 3]),          # the last phase begins on the last point
        2: path([1, None, 1, 2, 2]),       # missing points are passed over
        3: path([1, 2]),                   # two points: no path
        4: path([1, 1, 1]),
    })
    out = charts.bar_path_segments(table, span)
    shape = out.groupBy("clip_id", "segment", "bar_phase", "color", "label", "direction").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("frame"))).alias("frames"))
    assert rows_of(shape) == [
        (1, 1, 1, "orange", "Phase (Down)", "up", "0,1,2"),
        (1, 2, 2, "green", "Phase (Up)", "down", "2,3,4"),
        (2, 1, 1, "orange", "Phase (Down)", "up", "0,2,3"),
        (2, 2, 2, "green", "Phase (Up)", "down", "3,4"),
        (4, 1, 1, "orange", "Phase (Down)", "up", "0,1,2"),
    ]
    ends = charts.bar_path_markers(table).select("clip_id", "start_frame", "end_frame", "end_y")
    assert rows_of(ends) == [(1, 0, 4, 896.0), (2, 0, 4, 896.0), (4, 0, 2, 898.0)]


@pytest.mark.parametrize("span", SPANS)
def test_series_and_skipped(spark, span):
    table = analysis(spark, {
        1: path([1, 1, 2], specific_power_y_smooth=-1.0),
        2: [{"vel_y_smooth": 1.0, "accel_y_smooth": None, "barbell_x_stable": None}],
    })
    series = charts.chart_series(table, span)
    assert rows_of(series.groupBy("clip_id", "metric").count()) == [
        (1, "accel_y_smooth", 3), (1, "specific_power_y_smooth", 3), (1, "vel_y_smooth", 3)]
    extent = {r["metric"]: r["zero_line"] for r in charts.chart_extent(series).collect()}
    assert not any(extent.values())
    skipped = rows_of(charts.skipped_charts(clip_table(spark, [1, 2, 3]), table))
    velocity, accel, power = CHART_TITLES.values()
    assert skipped == sorted([
        (2, accel, 0, "missing"), (2, power, 0, "missing"), (2, velocity, 1, "insufficient"),
        (2, PATH_CHART_TITLE, 0, "missing"),
        *[(3, title, 0, "missing") for title in (velocity, accel, power, PATH_CHART_TITLE)],
    ])


def test_zero_line(spark):
    rows = [{"vel_y_smooth": v, "accel_y_smooth": a} for v, a in ((-1.0, 0.0), (2.0, 5.0))]
    extent = charts.chart_extent(charts.chart_series(analysis(spark, {1: rows})))
    assert rows_of(extent) == [
        (1, "accel_y_smooth", 0.0, 5.0, False), (1, "vel_y_smooth", -1.0, 2.0, True)]


@pytest.mark.parametrize("span", SPANS)
def test_states_with_a_gap_and_extra_frames(spark, span):
    table = analysis(spark, {1: path([1, 1, 1, 2, 2], lifter_angle_deg=45.0)}).where("frame <> 2")
    table = table.withColumn("lifter_angle_deg", F.when(F.col("frame") < 3, F.col("lifter_angle_deg")))
    clips = clip_table(spark, [1], total_frames=7)
    out = overlay.frame_state(overlay.render_plan(table, clips, span), table, span)
    got = rows_of(out.select(
        "frame", "analysed", "shake_x", "lifter_angle_deg", F.round("time_s", 3), "path_points"))
    assert got == [
        (0, True, 0.0, 45.0, 0.0, 1),
        (1, True, 0.5, 45.0, 0.033, 2),
        (2, False, 0.5, 45.0, 0.067, 4),   # a gap: last shake and angle, the whole path
        (3, True, 1.5, None, 0.1, 3),      # analysed: its own angle, even if unknown
        (4, True, 2.0, None, 0.133, 4),
        (5, False, 2.0, 45.0, 0.167, 4),   # after the analysis
        (6, False, 2.0, 45.0, 0.2, 4),
    ]
    trail = overlay.path_trail(table, span)
    assert rows_of(trail.select("segment", "frame", "x1", "x2", "color")) == [
        (1, 1, 100.0, 101.0, "orange"), (2, 3, 101.0, 103.0, "orange"),
        (3, 4, 103.0, 104.0, "green")]
    chosen = out.where("frame IN (0, 2, 3)")
    drawn = overlay.trail_on_frames(trail, chosen, span)
    # every earlier segment, moved by the frame's own shake and cut to whole pixels
    assert rows_of(drawn.select("frame", "segment", "x1", "y1", "x2", "y2"), "frame", "segment") == [
        (2, 1, 100, 899, 101, 898), (2, 2, 101, 898, 103, 896), (2, 3, 103, 896, 104, 895),
        (3, 1, 101, 898, 102, 897), (3, 2, 102, 897, 104, 895)]
    texts = rows_of(overlay.captions(out.where("frame IN (1, 4)")).select("frame", "text"))
    assert texts == [(1, "Frame: 1"), (1, "Lifter Angle: 45.0 deg"), (1, "Time: 0.03s"),
                     (4, "Frame: 4"), (4, "Time: 0.13s")]


def test_plan_ends_a_second_after_the_analysis(spark):
    table = analysis(spark, {1: path([1] * 5), 2: path([1] * 5)})
    clips = clip_table(spark, [1]).unionByName(clip_table(spark, [2], total_frames=3)) \
        .unionByName(clip_table(spark, [3], fps=24.9))
    plan = overlay.render_plan(table, clips).groupBy("clip_id").agg(F.max("frame"))
    assert rows_of(plan) == [(1, 33), (2, 2), (3, 23)]


def test_skeleton_joints_and_boxes(spark):
    rows = [{"left_hip_x": 0.5, "left_hip_y": 0.5, "left_knee_x": 0.501, "left_knee_y": 0.7,
             "left_shoulder_x": 0.5, "left_shoulder_y": 0.2, "barbell_box_str": "1.99,2.00,3.50,4.00"},
            {"left_hip_x": 0.5, "left_hip_y": 0.5}]
    table = analysis(spark, {1: rows})
    assert rows_of(overlay.skeleton_edges(table).drop("clip_id")) == [
        (0, 1, "Torso", 960, 216, 960, 540), (0, 8, "Left Leg", 960, 540, 961, 756)]
    assert rows_of(overlay.joint_points(table).drop("clip_id")) == [
        (0, "left_hip", 960, 540), (0, "left_knee", 961, 756), (0, "left_shoulder", 960, 216),
        (1, "left_hip", 960, 540)]
    assert rows_of(overlay.box_primitives(table)) == [(1, 0, "Barbell Box", 1, 2, 3, 4)]
