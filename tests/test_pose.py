"""Landmarks, angles and their text forms."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.functions.geometry import body_part, joint_angle, lifter_angle, truncate
from liftengine.functions.text import (
    box_to_text, fixed, landmarks_to_text, text_to_box, text_to_landmarks,
)
from liftengine.operators import pose
from tests.helpers import same


def point(a, b):
    return F.col(a), F.col(b)


def angles(spark, rows):
    df = spark.createDataFrame(
        rows, "id int, ax double, ay double, bx double, by double, cx double, cy double")
    return [r[0] for r in df.orderBy("id").select(
        joint_angle(point("ax", "ay"), point("bx", "by"), point("cx", "cy"))).collect()]


def test_joint_angle(spark):
    assert angles(spark, [
        (0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0),    # right angle
        (1, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0),    # point on the vertex
        (2, None, 0.0, 1.0, 0.0, 1.0, 1.0),   # missing
        (3, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0),    # straight
        (4, 2.0, 0.0, 1.0, 0.0, 2.0, 0.0),    # folded
    ]) == pytest.approx([90.0, None, None, 180.0, 0.0], nan_ok=True)


def test_joint_angle_stays_in_range(spark):
    number = st.floats(-1e3, 1e3, allow_nan=False)

    @settings(max_examples=5, deadline=None, derandomize=True)
    @given(st.lists(st.tuples(*[number] * 6), min_size=30, max_size=60))
    def check(points):
        found = angles(spark, [(i, *p) for i, p in enumerate(points)])
        assert all(a is None or 0.0 <= a <= 180.0 for a in found)

    check()


def test_lifter_angle(spark):
    df = spark.createDataFrame(
        [(0, 0.6, 0.0, 0.4, 0.0), (1, 0.5, 0.1, 0.5, 0.0), (2, 0.4, 0.0, 0.6, 0.0),
         (3, None, 0.0, 0.6, 0.0)],
        "id int, lx double, lz double, rx double, rz double")
    got = df.orderBy("id").select(lifter_angle(*map(F.col, ("lx", "lz", "rx", "rz")))).collect()
    assert [r[0] for r in got] == pytest.approx([90.0, 0.0, -90.0, None], nan_ok=True)


def test_edge_parts():
    assert [body_part(a, b) for a, b in schema.SKELETON_EDGES] == (
        ["Torso"] * 4 + ["Left Arm"] * 2 + ["Right Arm"] * 2 + ["Left Leg"] * 2
        + ["Right Leg"] * 2)
    assert body_part("left_wrist", "right_knee") == "White"


def test_truncation_is_towards_zero(spark):
    row = spark.range(1).select(truncate(F.lit(-2.9)), truncate(F.lit(2.9))).first()
    assert tuple(row) == (-2, 2)


@pytest.fixture(scope="module")
def landmark_rows(spark):
    rows = [(1, 0, name, 0.5, 0.25, -0.1, 0.1 + i / 50) for i, name in enumerate(schema.LANDMARKS)]
    rows += [(1, 1, "left_hip", 0.5, 0.4, 0.0, 0.9), (1, 1, "right_hip", 0.5, 0.6, 0.0, 0.05),
             (1, 2, "nose", 0.5, 0.6, 0.0, 0.9)]
    return spark.createDataFrame(rows, schema.LANDMARK_ROWS)


def test_both_layouts_give_the_same_columns(landmark_rows):
    long_form = pose.unpack_landmarks(
        pose.widen_landmarks(landmark_rows.where("landmark <> 'nose'")))
    from_map = pose.unpack_landmarks(pose.spread_landmarks(pose.pack_landmarks(landmark_rows)))
    names = ["clip_id", "frame", *schema.POSE_FIELDS]
    same(long_form.select(*names), from_map.select(*names), ["clip_id", "frame"])


def test_gates_and_hip_height(landmark_rows):
    sized = pose.widen_landmarks(landmark_rows).withColumns(
        {"frame_width": F.lit(1920), "frame_height": F.lit(1000)})
    rows = {r["frame"]: r for r in pose.with_pose(sized).collect()}
    # visibility of exactly the gate does not count, but is still reported
    assert rows[0]["left_shoulder_x"] is None and rows[0]["left_shoulder_vis"] == 0.1
    assert rows[0]["right_shoulder_x"] == 0.5
    # shoulders count for the turn whatever their visibility
    assert rows[0]["lifter_angle_deg"] == 90.0
    assert rows[0]["hip_y_avg"] == 250.0
    assert rows[1]["hip_y_avg"] == 400.0          # one hip in sight
    assert rows[1]["left_knee_angle"] is None
    assert rows[2]["hip_y_avg"] is None


def test_landmark_text(spark, landmark_rows):
    packed = pose.pack_landmarks(landmark_rows.where("landmark <> 'nose'"))
    text = packed.withColumn("t", landmarks_to_text(F.col("landmarks")))
    assert text.where("frame = 1").first()["t"] == (
        "{'left_hip': (0.5, 0.4, 0.0, 0.9), 'right_hip': (0.5, 0.6, 0.0, 0.05)}")
    back = text.withColumn("landmarks", text_to_landmarks(F.col("t")))
    same(pose.spread_landmarks(packed).drop("landmarks"),
         pose.spread_landmarks(back).drop("landmarks", "t"), ["clip_id", "frame"])
    odd = spark.createDataFrame([("{}",), ("",), (None,), ("{'left_hip': (1",), ("nonsense",)],
                                "t string")
    assert [r[0] for r in odd.select(F.size(text_to_landmarks(F.col("t")))).collect()] == [0] * 5
    missing = spark.range(1).select(landmarks_to_text(
        F.lit(None).cast("map<string,struct<x:double,y:double,z:double,vis:double>>")))
    assert missing.first()[0] == "{}"


def test_box_text(spark):
    texts = ["1.9,2,3,4", "1,2,3", "x", "", None, " 1 , -2.9,3e1,4.0", "1,2,3,4,5", "1,2,3,NaN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r[0] and tuple(r[0]) for r in df.orderBy("id").select(
        text_to_box(F.col("t"))).collect()]
    assert got == [(1, 2, 3, 4), None, None, None, None, (1, -2, 30, 4), None, None]
    boxes = spark.createDataFrame([(1.0, 2.345, 799.996, 0.125), (None, 1.0, 1.0, 1.0)],
                                  "a double, b double, c double, d double")
    assert [r[0] for r in boxes.select(box_to_text(*map(F.col, "abcd"))).collect()] == [
        f"1.00,{2.345:.2f},800.00,0.12", ""]
    assert spark.range(1).select(fixed(F.lit(0.5333), 2)).first()[0] == "0.53"
