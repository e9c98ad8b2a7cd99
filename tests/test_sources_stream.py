"""Reading, checking and writing tables; the stream against the batch."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from liftengine import schema
from liftengine.functions.text import fixed
from liftengine.operators import detection
from liftengine.plans import fleet
from liftengine.plans.span import Blocks
from fixtures import events
from liftengine.sources import sinks
from liftengine.sources.scratch import scratch_path, scratch_root, write_scratch
from liftengine.sources.tracks import (
    Tracks, clip_defaults, nan_to_null, read_tracks, validate_tracks, with_clip_metadata,
)
from liftengine.streaming.tracker import frame_stream, run_available
from tests.helpers import analysis, clip_table, rows_of, same

KEYS = ["clip_id", "frame"]


@pytest.fixture(scope="module")
def tracks(spark, small):
    return events.tracks_from_events(spark, small)


def test_read_tracks(spark):
    path = scratch_path(spark, "read")
    clip_table(spark, [1]).write.parquet(f"{path}/clips")
    spark.createDataFrame([(1, 0, float("nan"), 2.0), (1, 1, 1.0, float("nan"))],
                          "clip_id bigint, frame bigint, barbell_x_raw double, shake_dx double"
                          ).write.parquet(f"{path}/frames")
    got = read_tracks(spark, path)
    assert got.landmarks is None and got.detections is None
    assert got.frames.columns == schema.FRAMES.names
    assert rows_of(got.frames.select("frame", "barbell_x_raw", "shake_dx"), "frame") == [
        (0, None, 2.0), (1, 1.0, None)]


def test_nan_in_landmark_maps_is_missing(spark):
    frames = spark.sql("""SELECT map('left_hip', named_struct('x', double('NaN'), 'y', 0.5D,
        'z', 0D, 'vis', 1D)) AS landmarks""")
    point = nan_to_null(frames).select("landmarks.left_hip.*").first()
    assert tuple(point) == (None, 0.5, 0.0, 1.0)


def test_metadata_defaults(spark):
    clips = spark.createDataFrame([(1, 640, 480, 25.0, 9, "clean"), (2, None, None, None, 9, None)],
                                  schema.CLIPS)
    frames = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "clip_id bigint, frame bigint")
    assert rows_of(with_clip_metadata(frames, clips)) == [
        (1, 0, 640, 480, 25.0), (2, 0, 1920, 1080, 30.0), (3, 0, 1920, 1080, 30.0)]


def test_quarantine(spark):
    clips = clip_table(spark, [1, 2, 3]).unionByName(clip_table(spark, [4], fps=0.0)) \
        .unionByName(clip_table(spark, [5], fps=None))
    frames = spark.createDataFrame(
        [(1, 0), (1, 1), (2, 0), (2, 0), (4, 0), (5, 7)], "clip_id bigint, frame bigint")
    good, bad = validate_tracks(Tracks(clips=clips, frames=frames))
    assert rows_of(bad.select("clip_id", "problem")) == [
        (2, "duplicate_frame"), (3, "no_frames"), (4, "bad_fps")]
    assert rows_of(good.frames) == [(1, 0), (1, 1), (5, 7)]
    assert rows_of(good.clips.select("clip_id")) == [(1,), (5,)]
    blocked, _ = validate_tracks(Tracks(clips=clips, frames=frames, span=Blocks(1)))
    same(good.frames, blocked.frames, KEYS)
    again, none = validate_tracks(good)
    assert again is good and none.isEmpty()


def test_parquet_and_csv_round_trips(spark, tracks):
    table = write_scratch(fleet.analysis(
        tracks.frames, clip_defaults(tracks.clips), tracks.landmarks).where("clip_id < 4"))
    path = scratch_path(spark, "sinks")
    sinks.write_analysis(table, f"{path}/parquet")
    same(table, sinks.read_analysis(spark, f"{path}/parquet"), KEYS)
    sinks.export_analysis_csv(table, f"{path}/csv")
    back = sinks.import_analysis_csv(spark, f"{path}/csv")
    assert back.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.ANALYSIS]
    same(table, back, KEYS, digits=12)


def test_csv_columns_are_found_by_name(spark):
    """Files whose columns are in different orders, with text as another writer quotes it."""
    path = scratch_path(spark, "csv")
    names = list(schema.ANALYSIS_TYPES)
    lines = []
    for clip, order in ((7, names), (8, names[::-1])):
        values = {"frame_width": "1920", "phase_change": "True", "bar_phase": "2",
                  "left_hip_x": "0.25", "barbell_box_str": '"1.00,2.00,3.00,4.00"',
                  "landmarks_str": '"{\'left_hip\': (0.25, 1e-05, -0.1, 0.9)}"'}
        lines += [(clip, ",".join(["frame", *order])),
                  (clip, ",".join(["3", *[values.get(n, "") for n in order]])),
                  (clip, ",".join(["4", *["" for _ in order]]))]
    spark.createDataFrame(lines, "clip_id int, value string").coalesce(1).sortWithinPartitions(
        "clip_id").write.partitionBy("clip_id").text(f"{path}/raw")
    # the text writer names its files .txt; take them as they are
    got = sinks.import_analysis_csv(spark, f"{path}/raw", file_glob="*.txt")
    shown = got.select("clip_id", "frame", "frame_width", "phase_change", "bar_phase",
                       "left_hip_x", "barbell_box_str", "landmarks_str")
    text = "{'left_hip': (0.25, 1e-05, -0.1, 0.9)}"
    assert rows_of(shown, "clip_id", "frame") == [
        row for clip in (7, 8) for row in (
            (clip, 3, 1920, True, 2, 0.25, "1.00,2.00,3.00,4.00", text),
            (clip, 4, None, None, None, None, "", "{}"))]


def test_csv_with_more_columns_and_without_a_header(spark):
    """No column is lost to its place, and a file without a header is read by the contract."""
    path = scratch_path(spark, "csv")
    names = list(schema.ANALYSIS_TYPES)
    more = ["note", *[f"extra_{i}" for i in range(40)], *names]
    box = '"1.00,2.00,3.00,4.00"'
    lines = [(1, ",".join(["frame", *more])),
             (1, ",".join(["3", *[box if n == "barbell_box_str" else "" for n in more]])),
             (2, ",".join(["5", *["640" if n == "frame_width" else "" for n in names]]))]
    spark.createDataFrame(lines, "clip_id int, value string").coalesce(1).sortWithinPartitions(
        "clip_id").write.partitionBy("clip_id").text(f"{path}/raw")
    got = sinks.import_analysis_csv(spark, f"{path}/raw", file_glob="*.txt")
    assert rows_of(got.select("clip_id", "frame", "frame_width", "barbell_box_str")) == [
        (1, 3, None, "1.00,2.00,3.00,4.00"), (2, 5, 640, "")]


def write_lines(spark, path, *lines):
    """One text file with the lines in their order."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


@pytest.mark.parametrize("split", ["128m", "64"])
def test_csv_of_several_exports_put_together(spark, split):
    """Each line belongs to the last header before it, also where a split begins between."""
    path = scratch_path(spark, "csv")
    write_lines(spark, path, "5,640",  # before any header: the order of the contract
                "frame,frame_width,clip_id,note", "0,1920,1,first", "1,1921,1,second",
                "frame,clip_id,frame_width", "2,2,1280", "3,2,1281", "4,2,1282")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sinks.import_analysis_csv(spark, path, file_glob="*.txt", rescue=True)
        rows = rows_of(got.select(
            F.when(F.col("clip_id").isin(1, 2), F.col("clip_id")).alias("clip_id"), "frame",
            "frame_width", F.col("rescued")["note"].alias("note")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows, key=str) == sorted([
        (None, 5, 640, None), (1, 0, 1920, "first"), (1, 1, 1921, "second"),
        (2, 2, 1280, None), (2, 3, 1281, None), (2, 4, 1282, None)], key=str)


def test_exported_files_do_not_follow_the_clips(spark, tracks):
    table = write_scratch(fleet.analysis(
        tracks.frames, clip_defaults(tracks.clips), tracks.landmarks).coalesce(2))
    path = scratch_path(spark, "csv")
    sinks.export_analysis_csv(table.coalesce(2), path)
    files = spark.read.text(path).select("_metadata.file_path").distinct().count()
    assert files <= 2 < table.select("clip_id").distinct().count()


def test_reports(spark):
    path = scratch_path(spark, "reports")
    reports = spark.createDataFrame([(1, "# A\n\ntext"), (2, "# B")], "clip_id bigint, report string")
    sinks.write_report(reports, f"{path}/table")
    assert rows_of(spark.read.parquet(f"{path}/table")) == [(1, "# A\n\ntext"), (2, "# B")]
    sinks.export_reports(reports, f"{path}/files")
    texts = spark.read.text(f"{path}/files", wholetext=True)
    assert rows_of(texts.select("clip_id", "value")) == [(1, "# A\n\ntext\n"), (2, "# B\n")]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Cluster())


@pytest.mark.parametrize("digits", [1, 2])
def test_text_numbers_are_rounded_from_their_exact_value(spark, digits):
    values = [i * 0.005 for i in range(-400, 400)] + [i / 120 for i in range(600)] + [
        i / 240 for i in range(600)] + [2.675, 8.345, -0.001, 0.0, -0.0, 999.995, 1e15 + 0.5,
                                        123456789.125, 4503599627370497.5, 1e18]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", fixed(F.col("v"), digits)).collect()
    assert [(v, t) for v, t in got if t != f"{v:.{digits}f}"] == []


def test_scratch_is_the_checkpoint_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert root == shared if shared else root == spark.sparkContext.getCheckpointDir()


def test_landmark_maps_and_rows_give_the_same_analysis(tracks):
    from liftengine.operators.pose import pack_landmarks

    clips = clip_defaults(tracks.clips)
    packed = tracks.frames.join(pack_landmarks(tracks.landmarks), KEYS, "left")
    same(fleet.analysis(tracks.frames, clips, tracks.landmarks),
         fleet.analysis(packed, clips), KEYS)


def test_no_pose_at_all(tracks):
    table = fleet.analysis(tracks.frames, clip_defaults(tracks.clips))
    assert table.count() > 0
    assert table.where("landmarks_str <> '{}' OR hip_y_avg IS NOT NULL").isEmpty()


def test_detections_with_landmark_maps(tracks):
    from liftengine.operators.pose import pack_landmarks

    clips = clip_defaults(tracks.clips)
    packed = tracks.frames.join(pack_landmarks(tracks.landmarks), KEYS, "left")
    options = {"names": events.CLASS_NAMES, "span": tracks.span}
    from_maps = detection.collect_frames(packed, clips, tracks.detections, None, None, **options)
    from_rows = detection.collect_frames(
        tracks.frames, clips, tracks.detections, tracks.landmarks, None, **options)
    assert "landmarks" in from_maps.columns
    same(from_rows, from_maps, KEYS)


def test_analysis_has_its_contract(tracks):
    table = fleet.analysis(tracks.frames, clip_defaults(tracks.clips), tracks.landmarks)
    assert table.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.ANALYSIS]
    assert len(schema.ANALYSIS_TYPES) == 73


def test_run_options(tracks):
    plain = dataclasses.replace(tracks, detections=None)
    out = fleet.analyze(plain, lift_type="none", overlay_table=False, critique=False)
    assert "overlay" not in out and "report" not in out
    summary = out["run_summary"].select("lift_type", "overlay_part", "critique_part", "n_faults")
    assert summary.distinct().collect() == [("none", "skipped", "skipped", 0)]
    with pytest.raises(ValueError, match="lift_type"):
        fleet.analyze(plain, lift_type="jerk")
    clean = fleet.analyze(plain, lift_type="clean")
    counts = dict(rows_of(clean["faults"].groupBy("code").count()))
    # numbers stated in FIXTURES.md
    assert counts == {"FP_SLOW": 2, "FP_KICK": 8, "SP_HITCH": 9, "SP_ARMS": 5, "TP_STUCK": 6,
                      "RC_TIRING": 4}


def test_summary_counts_clips_without_rows(spark):
    clips = clip_table(spark, [1, 2])
    table = analysis(spark, {1: [{"barbell_y_stable": 1.0}]})
    out = fleet.run_summary(clips, table, table, table.select("clip_id").where("false"))
    assert rows_of(out.select("clip_id", "kept_frames", "analysis_part")) == [
        (1, 1, "done"), (2, 0, "no_frames")]


@pytest.fixture(scope="module")
def cands(tracks):
    clips = clip_defaults(tracks.clips)
    wanted = detection.clamp_boxes(
        detection.filter_detections(tracks.detections, names=events.CLASS_NAMES), clips)
    return write_scratch(detection.candidates(
        wanted, detection.feet_position(tracks.landmarks, clips)))


def check_stream(tracks, cands, out):
    seen = out.where("det_id IS NOT NULL").select(*KEYS, "det_id", "cx", "cy")
    same(detection.track_endcap(cands).select(*seen.columns), seen, KEYS)
    assert rows_of(out.where("not cast(late as boolean)").select(*KEYS)) == rows_of(tracks.frames.select(*KEYS))


def test_stream_equals_batch_and_counts_late_frames(spark, tracks, cands):
    rows = write_scratch(frame_stream(tracks.frames, cands))
    path = scratch_path(spark, "stream")
    # the third delivery repeats frames that are over
    for part in ("frame < 20", "frame BETWEEN 20 AND 40", "frame BETWEEN 38 AND 40", "frame > 40"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run_available(spark.readStream.schema(rows.schema).parquet(f"{path}/in"),
                      f"{path}/out", f"{path}/checkpoint")
    out = spark.read.parquet(f"{path}/out")
    check_stream(tracks, cands, out)
    repeated = tracks.frames.where("frame BETWEEN 38 AND 40").select(*KEYS)
    assert rows_of(out.where("cast(late as boolean)").select(*KEYS)) == rows_of(repeated)


def test_bounded_stream_loses_no_frame(spark, tracks, cands):
    """One file at a time, and every clip's frames dealt over all files in any order."""
    rows = frame_stream(tracks.frames, cands)
    path = scratch_path(spark, "stream")
    rows.repartition(6, F.hash(*KEYS)).sortWithinPartitions(F.desc("frame")).write.parquet(
        f"{path}/in")
    run_available(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    check_stream(tracks, cands, spark.read.parquet(f"{path}/out"))


def hot_clip(spark, frames):
    return spark.range(frames).selectExpr(
        "1L AS clip_id", "id AS frame", "id AS seq", "0.5D AS shake_dx", "-0.25D AS shake_dy",
        "array(0L, 1L) AS det_ids", "array(1D, 2D) AS first_keys",
        "array(id % 7, 100L + id) AS cxs", "array(5L, 6L) AS cys")


def deliver(spark, rows, path, files=1, **how):
    rows.repartition(files, F.hash("frame")).sortWithinPartitions(F.desc("frame")).write.mode(
        "append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/in")
    return run_available(stream, f"{path}/out", f"{path}/checkpoint", **how)


def test_a_hot_clip_loses_no_frame(spark):
    """50,000 frames of one clip over four files, each in descending order."""
    path = scratch_path(spark, "stream")
    assert deliver(spark, hot_clip(spark, 50_000), path, files=4) == 0
    out = spark.read.parquet(f"{path}/out")
    assert out.where("cast(late as boolean)").isEmpty()
    assert out.agg(F.count("*"), F.countDistinct("frame"), F.max("total_shake_x"),
                   F.max("late_frames")).first() == (50_000, 50_000, 25_000.0, 0)


def arriving(rows, day):
    return rows.withColumn("arrived", F.lit(f"2024-01-{day:02}").cast("timestamp"))


def test_missing_frames_are_given_up_by_the_watermark_alone(spark):
    path = scratch_path(spark, "stream")
    rows = hot_clip(spark, 2_000)
    other = rows.where("frame = 0").withColumn("clip_id", F.lit(2).cast("bigint"))
    deliver(spark, arriving(rows.where("frame <> 700"), 1), path)
    shown = spark.read.parquet(f"{path}/out")
    assert shown.count() == 700  # however many wait, they wait
    deliver(spark, arriving(other, 4), path)
    out = spark.read.parquet(f"{path}/out").where("clip_id = 1")
    assert out.count() == 1_999 and out.where("cast(late as boolean)").isEmpty()
    assert out.agg(F.max("total_shake_y")).first()[0] is not None
    deliver(spark, arriving(rows.where("frame = 700"), 5), path)
    late = spark.read.parquet(f"{path}/out").where("cast(late as boolean)")
    assert rows_of(late.select("clip_id", "frame", "late_frames")) == [(1, 700, 1)]


def test_rows_behind_the_watermark_are_counted(spark):
    path = scratch_path(spark, "stream")
    rows = hot_clip(spark, 10)
    deliver(spark, arriving(rows.where("frame < 5"), 9), path)
    assert deliver(spark, arriving(rows.where("frame >= 5"), 2), path) == 5


class FakeState(dict):
    """A map or value state of one key, in memory."""

    def exists(self):
        return "v" in self

    def get(self, key="v"):
        return super().get(key)

    def update(self, value):
        self["v"] = value

    def containsKey(self, key):  # noqa: N802
        return key in self

    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.pop  # noqa: N815


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, FakeState())

    getMapState = lambda self, name, key, value: self.getValueState(name, key)  # noqa: N815, E731

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


@pytest.mark.parametrize("chunk, held", [(1, 0), (3, 2), (256, 20_000)])
def test_any_order_over_any_chunks(chunk, held):
    """The processor alone, on shuffled frames with repeats, in batches of any size."""
    import random

    import pandas as pd

    from liftengine.streaming.tracker import BarTracker

    rng = random.Random(chunk)
    order = [*range(40), 7, 7, 30]
    rng.shuffle(order)
    tracker, seen, handle = BarTracker(chunk=chunk, held=held), [], FakeHandle()
    tracker.init(handle)
    while order:
        batches = []
        for _ in range(rng.randint(1, 3)):
            took = [order.pop() for _ in range(min(len(order), rng.randint(1, 6)))]
            if took:
                import numpy as np

                batches.append(pd.DataFrame({
                    "frame": [10 + 2 * i for i in took], "seq": took,
                    "shake_dx": 1.0, "shake_dy": 0.0, "det_ids": [np.array([0])] * len(took),
                    "first_keys": [np.array([0.0])] * len(took),
                    "cxs": [np.array([i]) for i in took], "cys": [np.array([0])] * len(took),
                    "arrived": pd.Timestamp("2024-01-01")}))
        seen += [row for out in tracker.handleInputRows((5,), iter(batches), None)
                 for row in out.itertuples()]
    taken = [row for row in seen if not row.late]
    assert [(r.frame, r.cx, r.total_shake_x) for r in taken] == [
        (10 + 2 * i, i, i + 1.0) for i in range(40)]
    assert sorted(r.frame for r in seen if r.late) == [24, 24, 70]
    assert not handle.states["waiting"] and len(handle.timers) == 1


def test_csv_lines_pass_through_python_once(spark):
    """And the header's columns are worked out per header, not as a map per line."""
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("frame,time_s,clip_id\n1,0.5,7\n2,,7",)], "value string").write.text(path)
    got = sinks.import_analysis_csv(spark, path, file_glob="*.txt")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "arrays_zip" not in plan
    assert rows_of(got.select("clip_id", "frame", "time_s")) == [(7, 1, 0.5), (7, 2, None)]


def test_csv_lines_are_not_moved(spark, monkeypatch):
    """Headers go to the lines; only where they are too many do lines go to their headers."""
    path = scratch_path(spark, "csv")
    write_lines(spark, path, "frame,time_s,clip_id", "1,0.5,7", "frame,clip_id,time_s", "2,7,0.25")
    shown = []
    for most in (sinks.SENT_FIELDS, 0):
        monkeypatch.setattr(sinks, "SENT_FIELDS", most)
        got = sinks.import_analysis_csv(spark, path, file_glob="*.txt")
        assert rows_of(got.select("clip_id", "frame", "time_s")) == [(7, 1, 0.5), (7, 2, 0.25)]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        shown.append(plan.count("rightHint=(strategy=broadcast)"))
    assert shown == [2, 1]


def test_packed_csv(spark, tracks, monkeypatch):
    """Packed files take a fraction of the disk, are bounded, and are read like others."""
    table = write_scratch(fleet.analysis(
        tracks.frames, clip_defaults(tracks.clips), tracks.landmarks).coalesce(1))
    path = scratch_path(spark, "csv")
    monkeypatch.setattr(sinks, "PACKED_ROWS", 500)
    sinks.export_analysis_csv(table, f"{path}/plain")
    sinks.export_analysis_csv(table, f"{path}/packed", compression="gzip")
    sizes = [spark.read.format("binaryFile").load(f"{path}/{kind}/*.csv{end}").agg(
        F.count("*"), F.sum("length")).first() for kind, end in (("plain", ""), ("packed", ".gz"))]
    assert sizes[1][1] < sizes[0][1] / 2
    assert sizes[1][0] == -(-table.count() // 500)
    same(table, sinks.import_analysis_csv(spark, f"{path}/packed"), KEYS, digits=12)


@pytest.mark.parametrize("numbered", [True, False])
def test_clips_without_gaps_ask_the_state_twice(numbered):
    """Frames that come in turn are neither set aside nor waited for, and make one table."""
    import numpy as np
    import pandas as pd

    from liftengine.streaming.tracker import OUTPUT, BarTracker

    class Counted(FakeState):
        asked = []

        def __getattribute__(self, name):
            if name in ("exists", "get", "update", "containsKey", "getValue", "updateValue", "keys"):
                Counted.asked.append(name)
            return super().__getattribute__(name)

    class Handle(FakeHandle):
        def getValueState(self, name, schema):  # noqa: N802
            return self.states.setdefault(name, Counted())

    tracker, handle = BarTracker(numbered), Handle()
    tracker.init(handle)
    Counted.asked.clear()
    batch = pd.DataFrame({
        "frame": [0, 1, 2], "seq": [0, 1, 2], "shake_dx": [1.0, np.nan, 1.0], "shake_dy": 0.0,
        "det_ids": [np.array([0]), np.array([]), np.array([3])],
        "first_keys": [np.array([0.0]), np.array([]), np.array([0.0])],
        "cxs": [np.array([4]), np.array([]), np.array([6])],
        "cys": [np.array([0]), np.array([]), np.array([0])],
        "arrived": pd.Timestamp("2024-01-01")})
    tables = list(tracker.handleInputRows((5,), iter([batch]), None))
    assert Counted.asked == ["get", "update"] and not handle.timers and len(tables) == 1
    assert tables[0].dtypes.astype(str).to_dict() == OUTPUT
    assert tables[0]["cx"].astype(object).tolist() == [4, pd.NA, 6]
    assert tables[0]["total_shake_x"].tolist() == ([1.0, 1.0, 2.0] if numbered else [0.0, 0.0, 1.0])


def test_growing_folder_is_analysed_once(spark, tracks):
    from liftengine.plans import incremental

    path, options = scratch_path(spark, "growing"), {"overlay_table": False}
    schema.with_missing_columns(tracks.frames, schema.FRAMES).write.parquet(f"{path}/frames")
    tracks.landmarks.write.parquet(f"{path}/landmarks")

    def deliver_clips(condition):
        tracks.clips.where(condition).write.mode("append").parquet(f"{path}/clips")
        incremental.analyze_new(spark, path, f"{path}/out", f"{path}/checkpoint", **options)

    assert incremental.finished(spark, f"{path}/out").isEmpty()
    deliver_clips("clip_id % 2 = 0")
    deliver_clips("clip_id < 9")
    deliver_clips("clip_id < 9")  # nothing new
    done = incremental.finished(spark, f"{path}/out")
    assert rows_of(done.groupBy("run").agg(F.count("*").alias("n"))) == [(0, 8), (1, 4)]
    whole = dataclasses.replace(tracks, detections=None, flow=None, clips=tracks.clips.join(
        done.select("clip_id"), "clip_id", "left_semi"))
    whole = dataclasses.replace(whole, frames=whole.frames.join(
        done.select("clip_id"), "clip_id", "left_semi"))
    full = fleet.analyze(whole, **options)
    for name in ("faults", "run_summary", "bar_path_markers"):
        same(full[name], incremental.read_results(spark, f"{path}/out", name).select(
            *full[name].columns), ["clip_id"] + (["ord"] if name == "faults" else []))
    # a run whose manifest is missing does not count
    full["faults"].write.parquet(f"{path}/out/faults/run=9")
    assert incremental.read_results(spark, f"{path}/out", "faults").where("run = 9").isEmpty()


def packed(frames, at):
    """A table of the tracker's packed rows, of frames with one candidate each."""
    import numpy as np
    import pandas as pd

    return pd.DataFrame({
        "clip_id": 5, "whole": [np.array([10 + i, i, at, 1, 100 + i, 7]) for i in frames],
        "broken": [np.array([1.0, np.nan, 0.5]) for _ in frames]})


class CountedState(FakeState):
    def __init__(self, asked):
        self.asked = asked

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "containsKey", "getValue", "updateValue", "keys"):
            self.asked.append(name)
        return super().__getattribute__(name)


class CountedHandle(FakeHandle):
    def __init__(self):
        super().__init__()
        self.asked = []

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, CountedState(self.asked))

    def registerTimer(self, at):  # noqa: N802
        self.asked.append("registerTimer")
        super().registerTimer(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked.append("deleteTimer")
        super().deleteTimer(at)


def test_short_clips_that_wait_ask_the_state_twice():
    """Few frames wait beside the clip's state, and the timer is set once."""
    from liftengine.streaming.tracker import PackedTracker

    tracker, handle = PackedTracker(), CountedHandle()
    tracker.init(handle)
    seen = []
    for part, at, asks in (((3, 1), 50, ["get", "registerTimer", "update"]),
                           ((5, 4, 3), 60, ["get", "update"]), ((2, 0), 70, ["get", "update"])):
        handle.asked.clear()
        tables = list(tracker.handleInputRows((5,), iter([packed(part, at)]), None))
        assert handle.asked == asks and handle.timers == {50}
        seen += [table["whole"][0][i:i + 7] for table in tables
                 for i in range(0, len(table["whole"][0]), 7)]
        shakes = [number for table in tables for number in table["broken"][0]]
    # frame 3 came twice: its second coming is late, and nothing else is
    assert seen == [[5, 13, None, None, None, 1, 1],
                    *[[5, 10 + i, 1, 100 + i, 7, 1, 0] for i in range(6)]]
    assert shakes[-4:] == [6.0, 0.0, 99.0, 7.0]


def test_a_timer_that_was_overtaken_is_set_anew():
    from liftengine.streaming.tracker import PackedTracker

    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    tracker, handle = PackedTracker(), CountedHandle()
    tracker.init(handle)
    for part, at in (((2,), 50), ((4, 3), 80)):
        assert not list(tracker.handleInputRows((5,), iter([packed(part, at)]), None))
    handle.timers.clear()  # as Spark does with one that expires
    assert not list(tracker.handleExpiredTimer((5,), Watermark(55), None))
    assert handle.timers == {80}
    handle.timers.clear()
    table, = tracker.handleExpiredTimer((5,), Watermark(80), None)
    assert table["whole"][0][1::7] == [12, 13, 14] and not handle.timers
