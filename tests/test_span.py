"""Clips cut into blocks give the same rows as whole clips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from liftengine.operators import charts, detection, faults, kinematics, overlay, phases
from liftengine.plans import fleet
from liftengine.plans.span import (
    BLOCK, Blocks, LastKnown, Nearby, NextKnown, Previous, RunningSum, Total, Whole,
    longest_group, measure, span_for,
)
from fixtures import events
from liftengine.sources.scratch import write_scratch
from liftengine.sources.tracks import clip_defaults, with_clip_metadata
from tests.helpers import same

KEYS = ["clip_id", "frame"]


@pytest.fixture(scope="module")
def sparse(spark):
    """Clips of uneven length, with frame gaps, missing values and whole empty blocks."""
    rng = random.Random(7)
    rows = []
    for clip, length in enumerate((1, 3, 17, 90, 260)):
        frame = rng.randrange(5)
        for _ in range(length):
            value = rng.choice([None, None, rng.randrange(-50, 50) / 4])
            if 100 < frame < 160:
                value = None
            rows.append((clip, frame, value))
            frame += rng.choice([1, 1, 1, 1, 2, 9, 60])
    return spark.createDataFrame(rows, "clip_id bigint, frame bigint, v double")


def needs():
    return {
        "running": RunningSum(F.col("v")),
        "row": RunningSum(F.lit(1)),
        "before": Previous(F.col("v")),
        "known": LastKnown(F.col("v")),
        "known_before": LastKnown(F.col("v"), inclusive=False),
        "ahead": NextKnown(F.col("v")),
        "lowest": Total("min", F.col("v")),
        "all": Total("sum", F.col("v")),
        "near": Nearby(F.coalesce("v", F.lit(0.0)), 14),
    }


@pytest.mark.parametrize("size", [1, 8, 64, 100_000])
def test_blocks_equal_whole(sparse, size):
    def shown(span):
        out = span.derive(sparse, **needs())
        return out.withColumn("near", F.concat_ws(",", F.transform(
            "near", lambda v: v.cast("string")))).drop(BLOCK)

    same(shown(Whole()), shown(Blocks(size)).select(*shown(Whole()).columns), KEYS)


def test_attach_and_spread(spark, sparse):
    per_clip = spark.createDataFrame([(2, "b"), (4, "d")], "clip_id bigint, name string")
    whole = Whole().attach(sparse, per_clip)
    same(whole, Blocks(8).attach(sparse, per_clip).drop(BLOCK), KEYS)
    counts = spark.createDataFrame([(0, 0), (1, 1), (2, 8), (3, 21)], "clip_id bigint, n bigint")
    spread = Blocks(8).spread(counts, F.col("n"), "frame")
    same(Whole().spread(counts, F.col("n"), "frame"), spread, KEYS)
    assert spread.count() == 30


def test_span_choice(sparse):
    assert longest_group(sparse, "clip_id") == 260
    assert isinstance(measure(sparse), Whole)
    assert measure(sparse, rows_per_task=100) == Blocks(100)
    assert span_for(None) == Whole()
    # both levels of a very long clip stay near the square root of its length
    longest = 10**11
    size = span_for(longest).size
    assert size == math.isqrt(longest) and longest / size < 2 * size
    # folding holds a bounded list, however long the clip is
    assert span_for(40_000).size == 32_768
    assert {(s.fold_size, s.fold_fan) for s in map(span_for, (40_000, longest))} == {(4_096, 256)}
    assert (Blocks(7).fold_size, Blocks(7).fold_fan) == (7, 4)


@pytest.fixture(scope="module")
def both(spark, small):
    """The fixture clips, in one piece and cut so that every clip counts as long."""
    return (events.tracks_from_events(spark, small),
            events.tracks_from_events(spark, small, rows_per_task=10))


def _sized(tracks):
    return with_clip_metadata(tracks.frames, tracks.clips, tracks.span)


def test_events_are_numbered_alike(both):
    whole, cut = both
    assert isinstance(cut.span, Blocks) and cut.span.size < 20
    for name in ("clips", "frames", "landmarks", "detections", "flow"):
        a, b = getattr(whole, name), getattr(cut, name)
        same(a, b, [c for c in ("clip_id", "frame", "landmark", "det_id", "feat_id")
                    if c in a.columns])


def test_events_are_numbered_once(both):
    """No table goes back to the events: all read the rows that were numbered once."""
    for tracks in both:
        read = {name: {file for file in getattr(tracks, name).inputFiles()}
                for name in ("frames", "landmarks", "detections", "flow")}
        assert len({frozenset(files) for files in read.values()}) == 1
        for name in ("clips", "frames"):
            assert not any("events.parquet" in file for file in getattr(tracks, name).inputFiles())


def test_time_slices_shrink_until_a_burst_fits(spark):
    rows = [(1, i, f"2024-01-01 00:{i // 2:02d}:{i % 2 * 30:02d}") for i in range(80)]
    rows += [(1, 100, "2024-12-31 00:00:00")]
    table = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts string").select(
        "user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    numbered = events.numbered(table, 81, rows_per_task=10)
    assert [r["frame"] for r in numbered.orderBy("ts").collect()] == list(range(81))
    width = events.slice_seconds(table, 81, 10)
    held = table.groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / width))
    assert held.count().agg(F.max("count")).first()[0] <= 10


def test_kinematics_and_pose(both):
    whole, cut = both
    a = fleet.analysis(whole.frames, clip_defaults(whole.clips), whole.landmarks, whole.span)
    b = fleet.analysis(cut.frames, clip_defaults(cut.clips), cut.landmarks, cut.span)
    same(a, b, KEYS)


def test_tracking(both):
    def tracked(t):
        clips = clip_defaults(t.clips)
        wanted = detection.clamp_boxes(
            detection.filter_detections(t.detections, names=events.CLASS_NAMES), clips, t.span)
        cands = detection.candidates(wanted, detection.feet_position(t.landmarks, clips, t.span))
        return detection.track_endcap(cands, t.span)

    a, b = map(tracked, both)
    same(a, b, KEYS)
    same(a, b.repartition(7), KEYS)


def test_everything_after_the_analysis(both):
    whole, cut = both
    clips = clip_defaults(whole.clips)
    table = write_scratch(
        fleet.analysis(whole.frames, clips, whole.landmarks, whole.span))
    span = Blocks(10)

    def results(span):
        critique = faults.critique(table, clips, span)
        states = overlay.frame_state(overlay.render_plan(table, clips, span), table, span)
        trail = overlay.path_trail(table, span)
        return {
            "critique": (critique.withColumn(
                "fault_codes", F.concat_ws(",", "fault_codes")), ["clip_id"]),
            "slices": (phases.phase_slices(table, phases.phases(table, span), span),
                       ["clip_id", "phase", "frame"]),
            "series": (charts.chart_series(table, span), ["clip_id", "metric", "frame"]),
            "segments": (charts.bar_path_segments(table, span),
                         ["clip_id", "segment", "frame"]),
            "states": (states, KEYS),
            "trail": (trail, ["clip_id", "segment"]),
            "drawn": (overlay.trail_on_frames(trail, overlay.last_states(states), span),
                      ["clip_id", "frame", "segment"]),
            "gaps": (kinematics.frame_gaps(table, span), ["clip_id"]),
            "shake": (detection.estimate_shake(whole.frames, whole.flow, span), KEYS),
        }

    ours, theirs = results(Whole()), results(span)
    for name, (df, keys) in ours.items():
        same(df, theirs[name][0], keys)


def test_whole_run_on_long_clips(both):
    """The full run, detections included, with every clip cut into blocks."""
    a, b = [fleet.analyze(t, names=events.CLASS_NAMES) for t in both]
    for name in ("run_summary", "critique_status", "report"):
        same(a[name], b[name], ["clip_id"])
    same(a["overlay"], b["overlay"],
         ["clip_id", "frame", "kind", "color", "text", "x1", "y1", "x2", "y2"])
