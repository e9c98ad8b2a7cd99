"""Tables stored by clip, and counts gathered in passing."""

import uuid

import pytest
from pyspark.sql import functions as F

from fixtures.events import CLASS_NAMES
from liftengine import schema
from liftengine.operators import overlay
from liftengine.plans import fleet
from liftengine.sources import clustered
from liftengine.sources.counts import Counts
from liftengine.sources.scratch import scratch_path, write_scratch
from liftengine.sources.tracks import read_tracks
from tests.helpers import clip_table, rows_of, same


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Two frame tables with a clip that holds most rows."""
    rows = spark.range(3_000).selectExpr(
        "CASE WHEN id < 2500 THEN 1L ELSE id % 40 END AS clip_id", "id AS frame", "id * 0.5D AS x")
    path, tag = scratch_path(spark, "stored"), uuid.uuid4().hex
    for name in ("left", "right"):
        clustered.save_clustered(
            rows.withColumnRenamed("x", name), f"{name}_{tag}", f"{path}/{name}", 8, 100)
    return [clustered.read_clustered(spark, f"{name}_{tag}") for name in ("left", "right")]


def test_stored_tables_join_without_an_exchange(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = clustered.join_clustered(*stored)
        assert "Exchange" not in plan_of(joined)
        sums = clustered.sum_up_clips(joined, ("n", F.lit(1)), ("x", F.col("left")))
        # sums per part lie where the rows are; only one row per part moves
        assert plan_of(sums).count("Exchange") == 1
        assert joined.where("left = right").count() == 3_000
        assert dict(rows_of(sums.select("clip_id", "n")))[1] == 2_500 + 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_long_clip_lies_in_many_buckets(stored):
    files = stored[0].where("clip_id = 1").select(F.input_file_name()).distinct().count()
    assert files == 8


def test_counts_in_passing(spark):
    path = scratch_path(spark, "counts")
    clip_table(spark, [1, 2]).unionByName(clip_table(spark, [3], fps=0.0)).write.parquet(
        f"{path}/clips")
    frames = spark.createDataFrame(
        [(c, f, float("nan") if f == 2 else 0.0) for c in (1, 3) for f in range(6)],
        "clip_id bigint, frame bigint, shake_dx double")
    schema.with_missing_columns(frames, schema.FRAMES).write.parquet(f"{path}/frames")
    det = [(1, f, 0, 0, "endcap", 0.9, 10.0, 10.0, 20.0, 20.0 + f) for f in range(8)]
    schema.with_missing_columns(spark.createDataFrame(
        det, "clip_id bigint, frame bigint, det_id bigint, class_id bigint, class_name string, "
        "conf double, x1 double, y1 double, x2 double, y2 double"), schema.DETECTIONS
    ).write.parquet(f"{path}/detections")
    counts = Counts()
    out = fleet.analyze(read_tracks(spark, path, counts), names=CLASS_NAMES,
                        overlay_table=False, counts=counts)
    got = {(r[0], r[1]): r[2] for r in out["run_counts"].collect()}
    analysed = {k: got.pop(k) for k in list(got) if k[0] == "analysis"}
    assert analysed["analysis", "rows"] == out["analysis"].count()
    assert got == {
        ("clips", "rows"): 3, ("clips", "rows_with_nan"): 0,
        ("clips", "no_frames"): 1, ("clips", "bad_fps"): 1,
        ("frames", "rows"): 12, ("frames", "rows_with_nan"): 2,
        ("detections", "rows"): 8, ("detections", "rows_with_nan"): 0,
        ("tracked", "rows"): 8, ("tracked", "orphan_detections"): 2,
    }


def test_trails_of_a_long_clip_stay_small(spark):
    """Every frame's trail by reference: n log n, and exact where it is written out."""
    n, top = 700, 4
    trail = write_scratch(spark.range(1, n).selectExpr(
        "1L AS clip_id", "id AS segment", "id AS frame", "id * 1.0D AS x1", "0.4D AS y1",
        "id + 1.0D AS x2", "-0.4D AS y2", "'red' AS color"))
    states = write_scratch(spark.range(n).selectExpr(
        "1L AS clip_id", "id AS frame", "id % 3 * 0.25D AS shake_x", "-0.2D AS shake_y",
        "id + 1 AS path_points"))
    pieces = overlay.trail_pieces(trail, top)
    assert pieces.agg(F.sum(F.size("segments"))).first()[0] <= (top + 1) * n
    assert pieces.agg(F.max(F.size("segments"))).first()[0] == 1 << top
    shown = overlay.frame_pieces(states, top)
    assert shown.groupBy("frame").count().agg(F.max("count")).first()[0] <= top + 1
    drawn = overlay.trail_on_frames(trail, states.where("frame % 7 = 0"), top=top)
    whole = {(f, s, int(s + f % 3 * 0.25), int(0.2), int(s + 1 + f % 3 * 0.25), int(-0.6))
             for f in range(0, n, 7) for s in range(1, f + 1)}
    got = drawn.select("frame", "segment", "x1", "y1", "x2", "y2").collect()
    assert len(got) == len(whole) and {tuple(r) for r in got} == whole


def test_columns_without_a_value(spark):
    table = spark.createDataFrame(
        [(1, 1.0, None), (1, None, None), (2, None, 3.0)], "clip_id bigint, a double, b double")
    assert rows_of(schema.empty_columns(table, ["a", "b", "c"])) == [
        (1, "b"), (1, "c"), (2, "a"), (2, "c")]


def _stored_columns(monkeypatch, *modules):
    """The columns of every table that these modules write to the scratch folder."""
    seen = []

    def noted(df, label="step"):
        seen.append(df.columns)
        return write_scratch(df, label)

    for module in modules:
        monkeypatch.setattr(module, "write_scratch", noted)
    return seen


def test_what_is_drawn_is_stored_without_the_rest(spark, small, monkeypatch):
    """Trails store no pose, states no landmarks, and the overlay no landmark text."""
    import __spark_entry__ as entry

    seen = _stored_columns(monkeypatch, entry)
    for name, wanted in (("trail_frames", overlay.SHIFTED), ("trail_all_frames", overlay.SHIFTED),
                         ("path_trail_last_frame", overlay.SHIFTED),
                         ("frame_state", overlay.STATED), ("overlay", overlay.DRAWN)):
        entry._QUERIES[name](entry.Fleet(spark, small))
        assert [tuple(columns) for columns in seen] == [wanted]
        seen.clear()


def test_scratch_tables_have_no_dictionaries(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    (file, *_) = write_scratch(spark.range(1000).selectExpr("id % 3 * 0.5D AS x")).inputFiles()
    column = pq.ParquetFile(Path(file.removeprefix("file://"))).metadata.row_group(0).column(0)
    assert not column.has_dictionary_page


def test_the_stored_analysis_is_numbers(spark, small, monkeypatch):
    """Texts are worked out where they are asked for; the table is the same."""
    import __spark_entry__ as entry

    seen = _stored_columns(monkeypatch, fleet)
    f = entry.Fleet(spark, small)
    table = fleet.analyze(f.tables.tracks(), names=CLASS_NAMES)["analysis"]
    assert any("_left_hip_x" in columns for columns in seen)
    assert not any("landmarks_str" in columns for columns in seen)
    keys = ["clip_id", "frame"]
    assert table.columns == [*keys, *schema.ANALYSIS_TYPES]
    same(table, f.full_analysis(), keys)
