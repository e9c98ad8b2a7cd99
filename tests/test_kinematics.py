"""Hand-made clips for the bar's kinematics."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftengine.functions.smoothing import WIDTHS, cubic_weights
from liftengine.operators import kinematics as K
from liftengine.plans.span import Whole
from tests.helpers import frames, rows_of, same

SPAN = Whole()


def values(df, column, clip):
    rows = df.where(F.col("clip_id") == clip).orderBy("frame").select(column).collect()
    return [r[0] for r in rows]


def smoothed(series):
    """The same smoothing by a polynomial fit per point."""
    n = len(series)
    width = min(15, n if n % 2 else n - 1)
    if width < 5:
        return list(series)
    out = []
    for p in range(n):
        start = min(max(p - width // 2, 0), n - width)
        x = np.arange(start, start + width) - p
        out.append(np.polynomial.Polynomial.fit(x, series[start:start + width], 3)(0))
    return out


def test_no_bar_at_all(spark):
    table = K.kinematics(frames(spark, {1: [None] * 8}))
    assert values(table, "frame", 1) == list(range(8))  # nothing is cut off
    assert values(table, "vel_y_px_s", 1) == [None] * 8
    assert values(table, "vel_y_smooth", 1) == [0.0] * 8
    assert values(table, "direction_state", 1) == [1.0] * 8
    assert values(table, "phase_change", 1) == [True] + [False] * 7
    assert values(table, "bar_phase", 1) == [1] * 8
    assert K.detection_rate(table).first()["detection_rate"] == 0.0


def test_cut_at_first_highest_point(spark):
    tracks = frames(spark, {1: [900, 800, 700, 750, 700, 720], 2: [None, 5, None, 3, None]})
    track = K.stable_track(tracks)
    assert values(track, "frame", 1) == [0, 1, 2]
    assert values(track, "frame", 2) == [0, 1, 2, 3]
    again = K.truncate_at_peak(track.drop("_prev_y"))
    same(track.select("clip_id", "frame"), again.select("clip_id", "frame"), ["clip_id", "frame"])


def test_time_and_velocity_span_frame_gaps(spark):
    tracks = frames(spark, {1: [900, 890, 880, 840]}, frame_numbers={1: [4, 5, 8, 10]})
    table = K.smoothed_track(tracks)
    assert values(table, "time_s", 1) == [0.0, 1 / 30, 4 / 30, 6 / 30]
    assert values(table, "dt", 1)[0] == 1 / 30
    assert values(table, "vel_y_px_s", 1) == pytest.approx([None, 300, 100, 600], nan_ok=True)
    assert K.frame_gaps(tracks).first()["frame_gaps"] == 2


def test_gaps_in_velocity(spark):
    #            leading        inner          trailing is cut at the peak, so use the chain
    series = {1: [None, None, 4.0, None, None, 10.0, None, None], 2: [None, None], 3: [None, 2.0]}
    rows = [(c, i, i + 1, v) for c, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "clip_id bigint, frame bigint, _row bigint, v double")
    filled = K.interpolate_linear(df, "v", "out")
    assert values(filled, "out", 1) == [0.0, 0.0, 4.0, 6.0, 8.0, 10.0, 10.0, 10.0]
    assert values(filled, "out", 2) == [0.0, 0.0]
    assert values(filled, "out", 3) == [0.0, 2.0]
    assert set(values(filled, "_rows", 1)) == {8}


@pytest.mark.parametrize("width", WIDTHS)
def test_weights_keep_cubics(width):
    x = np.arange(width)
    cubic = 0.5 * x**3 - 2 * x**2 + x - 7
    assert np.allclose(cubic_weights(width) @ cubic, cubic)


def test_middle_weights_of_the_widest_window():
    known = np.array([-78, -13, 42, 87, 122, 147, 162, 167, 162, 147, 122, 87, 42, -13, -78])
    assert np.allclose(cubic_weights(15)[7], known / 1105)


def test_smoothing_of_short_and_long_clips(spark):
    rng = np.random.default_rng(3)
    series = {n: rng.normal(0, 50, n).tolist() for n in (1, 2, 3, 4, 5, 6, 7, 13, 14, 15, 16, 40)}
    rows = [(n, i, i + 1, n, v) for n, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(
        rows, "clip_id bigint, frame bigint, _row bigint, _rows bigint, v double")
    out = K.savgol(df, "v", "out").cache()
    for n, vs in series.items():
        assert values(out, "out", n) == pytest.approx(smoothed(vs), abs=1e-9)
    assert values(out, "out", 4) == series[4]  # too short for any window


def test_direction_and_phases(spark):
    speeds = [0, 5, 60, 3, -2, -60, -4, 2, 70, -10.5, 100]
    rows = [(1, i, i + 1, float(v), 10.0) for i, v in enumerate(speeds)]
    df = spark.createDataFrame(
        rows, "clip_id bigint, frame bigint, _row bigint, vel_y_smooth double, "
              "vel_threshold double")
    out = K.bar_phase(K.direction(df))
    assert values(out, "direction_state", 1) == [1, 1, 1, 1, 1, -1, -1, -1, 1, -1, 1]
    assert values(out, "bar_phase", 1) == [1, 1, 1, 1, 1, 2, 2, 2, 3, 4, 5]
    down = df.withColumn("vel_y_smooth", F.when(F.col("frame") == 0, -99.0).otherwise(0.0))
    first = K.bar_phase(K.direction(down))
    assert values(first, "bar_phase", 1) == [1] * len(speeds)


def test_speed_threshold(spark):
    df = spark.createDataFrame(
        [(1, 0, 40.0, 1.0), (1, 1, -400.0, 1.0), (2, 0, 30.0, 1.0)],
        "clip_id bigint, frame bigint, vel_y_smooth double, dt double")
    out = K.acceleration(df)
    assert values(out, "vel_threshold", 1) == [20.0, 20.0]
    assert values(out, "vel_threshold", 2) == [10.0]
    assert values(out, "accel_y_smooth", 1) == [None, -440.0]
    assert values(out, "specific_power_y_smooth", 1) == [None, 176000.0]


def test_shake_adds_up_and_skips_missing(spark):
    tracks = frames(spark, {1: [10, 10, 10, 10]}, {1: [(1.0, 2.0), (0.5, None), (None, 1.0), (1.0, 1.0)]})
    out = K.stabilize(K.cumulative_shake(tracks))
    assert values(out, "total_shake_x", 1) == [1.0, 1.5, None, 2.5]
    assert values(out, "total_shake_y", 1) == [2.0, None, 3.0, 4.0]
    assert values(out, "barbell_y_stable", 1) == [8.0, None, 7.0, 6.0]


def test_center_is_optional(spark):
    plain = spark.range(1).select(F.col("id").alias("clip_id"))
    assert rows_of(K.unpack_center(plain)) == [(0, None, None)]
    with_center = plain.withColumn("barbell_center", F.expr("named_struct('x', 3, 'y', 4)"))
    assert K.unpack_center(with_center).first()["barbell_y_raw"] == 4.0


heights = st.lists(
    st.one_of(st.none(), st.integers(0, 4000).map(lambda q: q / 4)), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(clip=heights, lift=st.integers(-40, 40))
def test_moving_the_camera_leaves_speeds_alone(spark, clip, lift):
    moved = [None if y is None else y + lift for y in clip]
    table = K.kinematics(frames(spark, {1: clip, 2: moved})).repartition(5, "frame").cache()
    for column in ("vel_y_px_s", "vel_y_smooth", "bar_phase", "frame"):
        a, b = values(table, column, 1), values(table, column, 2)
        assert a == pytest.approx(b, abs=1e-7)
    times = values(table, "time_s", 1)
    assert all(x < y for x, y in zip(times, times[1:])) and not any(map(math.isnan, times))
