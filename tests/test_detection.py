"""Choosing and following the barbell; shake."""

import random

import pytest

from liftengine import schema
from liftengine.operators import detection as D
from liftengine.plans.span import Blocks, Whole
from liftengine.sources.scratch import write_scratch
from tests.helpers import clip_table, rows_of, same


def detections(spark, rows):
    """Rows of (clip, frame, det, centre x, centre y): boxes 20 pixels wide."""
    return spark.createDataFrame(
        [(c, f, d, 0, 0.9, x - 10.0, y - 10.0, x + 10.0, y + 10.0) for c, f, d, x, y in rows],
        schema.DETECTIONS)


def ankles(spark, rows):
    return spark.createDataFrame(
        [(c, f, f"{side}_ankle", x, y, 0.0, vis) for c, f, side, x, y, vis in rows],
        schema.LANDMARK_ROWS)


def candidates(spark, det_rows, ankle_rows, clip_ids):
    clips = clip_table(spark, clip_ids)
    clamped = D.clamp_boxes(detections(spark, det_rows), clips)
    return D.candidates(clamped, D.feet_position(ankles(spark, ankle_rows), clips))


@pytest.mark.parametrize("wanted, names, kept", [
    ("endcap", {0: "plate", 1: "endcap"}, [1]),
    ("barbell", {0: "plate", 1: "endcap"}, [0]),      # unknown: the name of id 0
    ("endcap", None, [0]),                            # no names: id 0
    ("endcap", {1: "endcap", 2: "plate"}, [0, 1]),    # an id without a name counts if it is 0
    ("plate", {0: "plate", 1: "plate"}, [0, 1]),
])
def test_class_choice(spark, wanted, names, kept):
    rows = [(1, 0, i, i, 0.25, 1.0, 1.0, 2.0, 2.0) for i in range(3)]
    rows += [(1, 0, 9, i, 0.24, 1.0, 1.0, 2.0, 2.0) for i in range(3)]
    det = spark.createDataFrame(rows, schema.DETECTIONS)
    got = D.filter_detections(det, wanted, names=names).select("class_id", "conf")
    assert rows_of(got) == [(i, 0.25) for i in kept]


def test_boxes_are_cut_to_the_frame(spark):
    rows = [(1, 0, 0, 0, 0.9, -5.0, -1.0, 4.9, 2.0), (1, 0, 1, 0, 0.9, 1900.0, 1070.0, 1950.0, 1100.0)]
    out = D.clamp_boxes(spark.createDataFrame(rows, schema.DETECTIONS), clip_table(spark, [1]))
    got = rows_of(out.select("det_id", *D.BOX, "cx", "cy"))
    assert got == [(0, 0.0, 0.0, 4.9, 2.0, 2, 1), (1, 1900.0, 1070.0, 1919.0, 1079.0, 1909, 1074)]


def test_feet(spark):
    feet = D.feet_position(ankles(spark, [
        (1, 0, "left", 0.5, 0.5, 0.9), (1, 0, "right", 0.25, 0.7, 0.31),
        (1, 1, "left", 0.5, 0.5, 0.3), (1, 1, "right", 0.25, 0.5, 0.9),   # gate is exclusive
        (1, 2, "left", 0.5, 0.5, 0.1),
    ]), clip_table(spark, [1]))
    assert rows_of(feet, "frame") == [
        (1, 0, 720.0, pytest.approx(648.0)), (1, 1, 480.0, 540.0), (1, 2, None, None)]


def test_first_choice(spark):
    cands = candidates(spark, [
        (1, 3, 0, 900, 500), (1, 3, 1, 200, 900), (1, 4, 0, 0, 0),   # feet at 192, 972
        (2, 0, 0, 700, 500), (2, 0, 1, 1000, 100),                   # nobody: nearest to 960
        (3, 0, 4, 950, 500), (3, 0, 2, 970, 500),                    # a tie: detector order
    ], [(1, 3, "left", 0.1, 0.9, 0.9)], [1, 2, 3])
    first = D.initial_endcap(cands).select("clip_id", "frame", "det_id", "chosen_by")
    assert rows_of(first) == [(1, 3, 1, "feet"), (2, 0, 1, "center"), (3, 0, 2, "center")]


def test_following_keeps_the_state_over_empty_frames(spark):
    cands = candidates(spark, [
        (1, 0, 0, 960, 500), (1, 5, 0, 300, 500), (1, 5, 1, 1000, 520),
        (1, 6, 0, 995, 525), (1, 6, 1, 1005, 515),                   # a tie again
    ], [], [1])
    path = D.track_endcap(cands).select("frame", "det_id", "cx", "cy")
    assert rows_of(path) == [(0, 0, 960, 500), (5, 1, 1000, 520), (6, 0, 995, 525)]


def brute_force(rows):
    """The track of each clip, one frame after the other."""
    out, state = {}, {}
    frames = {}
    for c, f, d, x, y in rows:
        frames.setdefault((c, f), []).append((d, x, y))
    for (c, f), options in sorted(frames.items()):
        def key(o):
            if c not in state:
                return abs(o[1] - 960), o[0]
            return (o[1] - state[c][0]) ** 2 + (o[2] - state[c][1]) ** 2, o[0]
        d, x, y = min(options, key=key)
        state[c] = (x, y)
        out[c, f] = (d, x, y)
    return sorted((c, f, *v) for (c, f), v in out.items())


@pytest.mark.parametrize("span", [Whole(), Blocks(1), Blocks(7), Blocks(50)])
def test_following_by_brute_force(spark, span):
    rng = random.Random(11)
    rows = [
        (c, f, d, rng.randrange(20, 1900), rng.randrange(20, 1060))
        for c, length in ((1, 700), (2, 40), (3, 1)) for f in range(length)
        for d in range(rng.choice([0, 1, 2, 3, 4]))
    ] + [(3, 5, 0, 50, 50)]
    path = D.track_endcap(candidates(spark, rows, [], [1, 2, 3]), span)
    assert rows_of(path.select("clip_id", "frame", "det_id", "cx", "cy")) == brute_force(rows)


def test_long_clips_are_composed_over_levels(spark, monkeypatch):
    """Three levels of groups, none of which holds more than its share."""
    rng = random.Random(3)
    rows = [(1, f, d, rng.randrange(20, 1900), rng.randrange(20, 1060))
            for f in range(500) for d in range(2)] + [(2, 3, 0, 50, 50), (2, 499, 0, 60, 50)]
    span, written = Blocks(8), []

    def noted(df, *label):
        written.append(write_scratch(df, *label))
        return written[-1]

    monkeypatch.setattr(D, "write_scratch", noted)
    path = D.track_endcap(candidates(spark, rows, [], [1, 2]), span)
    assert rows_of(path.select("clip_id", "frame", "det_id", "cx", "cy")) == brute_force(rows)
    sizes = [df.selectExpr("max(size(steps))").first()[0]
             for df in written if "steps" in df.columns]
    assert (span.fold_size, span.fold_fan) == (8, 4)
    assert sizes == [8, 4, 4, 4]


def test_shake(spark):
    frames = spark.createDataFrame([(1, f) for f in range(4)], "clip_id bigint, frame bigint")
    flow = [(1, 0, i, 9.0, 9.0, 1) for i in range(8)]                  # first frame: 0
    flow += [(1, 1, i, float(i), -1.0, 1) for i in range(6)]           # six: enough
    flow += [(1, 1, 9, 99.0, 99.0, 0)]                                 # lost: not counted
    flow += [(1, 2, i, 5.0, 5.0, 1) for i in range(5)]                 # five: too few
    table = spark.createDataFrame(flow, schema.FLOW)
    for span in (Whole(), Blocks(2)):
        assert rows_of(D.estimate_shake(frames, table, span)) == [
            (1, 0, 0.0, 0.0), (1, 1, 2.5, -1.0), (1, 2, 0.0, 0.0), (1, 3, 0.0, 0.0)]


def test_partitioning_does_not_matter(spark):
    rng = random.Random(5)
    rows = [(1, f, d, rng.randrange(20, 1900), 500) for f in range(60) for d in range(3)]
    cands = candidates(spark, rows, [], [1])
    same(D.track_endcap(cands), D.track_endcap(cands.repartition(9)), ["clip_id", "frame"])
