"""Following the bar on a stream of frames with their detections.

Each row is one frame with all its candidates.  State per clip: the centre chosen last, the
camera shake added up, the place of the next frame, and the frames that came before their
turn.  Up to ``CHUNK`` of these are kept with the rest, so that a short clip asks for its state
once and writes it once.  Where more wait, they do so in a map state, ``CHUNK`` frames to an entry,
and a micro-batch reads and writes only the entries it touches, however long the clip is.

With short clips a micro-batch holds few rows of each, and a table of them costs more than the
rows, the more so the more columns it has.  So frames come, and rows go, as two lists each, of
whole numbers and of others.

Where rows carry ``seq``, their position in the clip counted from 0 without gaps, a frame
waits for all before it: files may come in any order and any bounds.  A missing frame is
given up when nothing more of the clip has come for ``patience``, measured in arrival time by
the stream's watermark; then the clip goes on without it.  Nothing else gives up a frame.
Where rows come from a stage that itself is complete up to the watermark (`raw`), there is
nothing to wait for and a micro-batch is taken in order of frames.

A frame that comes again, or after its clip has gone on without it, is late and goes to the
table of late frames.  Rows that arrived before the watermark are dropped by Spark, which
counts them.
"""

from __future__ import annotations

import json
import math
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from liftengine.plans.span import RunningSum, Whole, join_frames

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not install this

# frames to an entry of the map state, and frames of a micro-batch kept outside it
CHUNK = 256
HELD = 20_000
# rows given out at once; making a table of rows costs more than the rows
GIVEN = 10_000
PATIENCE = "1 day"
STATE = ("sx bigint, sy bigint, shake_x double, shake_y double, next_seq bigint, "
         "late_frames bigint, latest bigint, waiting bigint, timer bigint, few string")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = {
    "clip_id": "int64", "frame": "int64", "det_id": "Int64", "cx": "Int64", "cy": "Int64",
    "total_shake_x": "float64", "total_shake_y": "float64", "barbell_x_stable": "float64",
    "barbell_y_stable": "float64", "late_frames": "int64", "late": "bool",
}
OPTIONS = ("det_ids", "first_keys", "cxs", "cys")
# the rows given, as they are packed: the numbers of each row one after another
WHOLE = ("clip_id", "frame", "det_id", "cx", "cy", "late_frames", "late")
BROKEN = ("total_shake_x", "total_shake_y", "barbell_x_stable", "barbell_y_stable")
PACKED_DDL = "whole array<bigint>, broken array<double>"


def frame_stream(frames: DataFrame, cands: DataFrame, span=Whole()) -> DataFrame:
    """Batch rows in the stream's layout: one row per frame, its candidates as four arrays."""
    placed = span.derive(frames.select("clip_id", "frame", "shake_dx", "shake_dy"),
                         _nth=RunningSum(F.lit(1)))
    options = cands.groupBy("clip_id", "frame").agg(
        F.sort_array(F.collect_list(F.struct("det_id", "first_key", "cx", "cy"))).alias("o"))
    return join_frames(placed, options).select(
        "clip_id", "frame", (F.col("_nth") - 1).cast("bigint").alias("seq"), "shake_dx", "shake_dy",
        *[F.coalesce(F.col("o")[name], F.array().cast(f"array<{kind}>")).alias(alias)
          for name, kind, alias in zip(("det_id", "first_key", "cx", "cy"),
                                       ("bigint", "double", "bigint", "bigint"), OPTIONS)])


def _nearest(frame, sx, sy):
    """The candidate to take, given the centre chosen last (or none); None without any."""
    def key(option):
        det_id, first_key, cx, cy = option
        return (first_key if sx is None else (cx - sx) ** 2 + (cy - sy) ** 2), det_id

    return min(zip(*frame[4:]), key=key, default=None)


def _number(shake) -> float:
    return shake if math.isfinite(shake) else float(np.nan_to_num(shake))


def _column(values: tuple, kind: str):
    """Values as an array of the output's kind."""
    if kind != "Int64":
        return np.array(values, kind)
    missing = np.array([v is None for v in values], bool)
    return pd.arrays.IntegerArray(
        np.array([0 if v is None else v for v in values], np.int64), missing)


def _frames(batch: pd.DataFrame):
    """[frame, seq, shake_dx, shake_dy, four lists] of each row."""
    plain = [batch[c].tolist() for c in ("frame", "seq", "shake_dx", "shake_dy")]
    lists = [[[] if x is None else x.tolist() for x in batch[c]] for c in OPTIONS]
    return map(list, zip(*plain, *lists))


class Walk:
    """One clip's walk through its frames, with the rows it gives."""

    NONE = (None, None, None)

    def __init__(self, clip, state, first_still=False):
        self.clip, self.out, self.first_still = clip, [], first_still
        (self.sx, self.sy, self.shake_x, self.shake_y, self.turn, self.late,
         self.latest, self.waiting, self.timer, self.few) = state or (
             None, None, 0.0, 0.0, 0, 0, 0, 0, None, None)

    def state(self):
        return (self.sx, self.sy, self.shake_x, self.shake_y, self.turn, self.late, self.latest,
                self.waiting, self.timer, self.few)

    def step(self, frame):
        if not (self.first_still and self.turn == 0):
            self.shake_x += _number(frame[2])
            self.shake_y += _number(frame[3])
        self.turn = frame[1] + 1
        chosen, seen, stable = _nearest(frame, self.sx, self.sy), self.NONE, (np.nan, np.nan)
        if chosen:
            self.sx, self.sy = int(chosen[2]), int(chosen[3])
            seen = (int(chosen[0]), self.sx, self.sy)
            stable = (self.sx - self.shake_x, self.sy - self.shake_y)
        self.out.append((self.clip, frame[0], *seen, self.shake_x, self.shake_y, *stable,
                         self.late, False))

    def too_late(self, frame):
        self.late += 1
        self.out.append((self.clip, frame[0], *self.NONE, self.shake_x, self.shake_y, np.nan,
                         np.nan, self.late, True))

    def rows(self):
        columns = zip(*self.out) if self.out else [()] * len(OUTPUT)
        made = pd.DataFrame({name: _column(values, kind) for (name, kind), values
                             in zip(OUTPUT.items(), columns)}, copy=False)
        self.out = []
        return made


class BarTracker(StatefulProcessor):
    """Frames of each clip in order, continued from the clip's state.

    ``numbered`` clips have positions without gaps; others are complete in each micro-batch,
    and the camera counts as still on their first frame.  Tables have a column for each value.
    """

    def __init__(self, numbered: bool = True, chunk: int = CHUNK, held: int = HELD):
        self.numbered, self.chunk, self.most = numbered, chunk, held

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getMapState("waiting", "chunk bigint", "frames string")

    def _walk(self, clip) -> Walk:
        return Walk(clip, self.last.get(), first_still=not self.numbered)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if pd.isna(key[0]):  # rows that only move the watermark
            return
        walk = self._walk(key[0])
        held: dict[int, list] = self._few(walk)
        for batch in rows:
            frames, latest = self._read(batch)
            walk.latest = max(walk.latest, latest)
            for frame in frames:
                if frame[1] < walk.turn or frame[1] in held:
                    walk.too_late(frame)
                else:
                    held[frame[1]] = frame
            if self.numbered:
                self._go_on(walk, held)
            if len(held) > self.most:
                self._set_aside(walk, held)
            if len(walk.out) >= GIVEN:
                yield self._given(walk)
        if self.numbered:
            if walk.waiting or len(held) > self.chunk:
                self._set_aside(walk, held)
            elif held:
                walk.few = json.dumps(list(held.values()))
            self._wake(walk)
        elif walk.waiting:
            self._set_aside(walk, held)
            yield from self._without_missing(walk)
        else:
            for seq in sorted(held):
                walk.step(held[seq])
        self.last.update(walk.state())
        if walk.out:
            yield self._given(walk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """Give up what is missing, if nothing came for as long as frames are waited for."""
        walk = self._walk(key[0])
        walk.timer = None
        if walk.latest > timerValues.getCurrentWatermarkInMs():
            self._wake(walk)
        else:
            yield from self._without_missing(walk)
        self.last.update(walk.state())
        if walk.out:
            yield self._given(walk)

    def _read(self, batch: pd.DataFrame):
        """The frames of a table, and when the last of them arrived."""
        return _frames(batch), int(batch["arrived"].max().timestamp() * 1000)

    def _given(self, walk: Walk) -> pd.DataFrame:
        return walk.rows()

    def _few(self, walk: Walk) -> dict[int, list]:
        """Take the frames that wait beside the map state."""
        few, walk.few = walk.few, None
        return {frame[1]: frame for frame in json.loads(few)} if few else {}

    def _wake(self, walk: Walk) -> None:
        """Set the timer of a clip that waits, unless one is set.

        It is not moved when more arrives: it then finds that it was too early, and is set anew.
        One that is left over finds nothing to do.
        """
        if (walk.waiting or walk.few) and walk.timer is None:
            self.handle.registerTimer(walk.latest)
            walk.timer = walk.latest

    def _chunk(self, walk: Walk, number: int) -> dict[int, list]:
        if not walk.waiting or not self.waiting.containsKey((number,)):
            return {}
        return {frame[1]: frame for frame in json.loads(self.waiting.getValue((number,))[0])}

    def _take(self, walk: Walk, number: int, stored: dict) -> None:
        self.waiting.removeKey((number,))
        walk.waiting -= len(stored)

    def _go_on(self, walk: Walk, held: dict) -> None:
        """Take frames while the next one is there, in ``held`` or in the state."""
        while True:
            while walk.turn in held:
                walk.step(held.pop(walk.turn))
            number = walk.turn // self.chunk
            stored = self._chunk(walk, number)
            if walk.turn not in stored:
                return
            self._take(walk, number, stored)
            for seq, frame in stored.items():
                if seq in held:
                    walk.too_late(held[seq])
                held[seq] = frame

    def _set_aside(self, walk: Walk, held: dict) -> None:
        """Move what waits to the state."""
        chunks = defaultdict(dict)
        for seq, frame in held.items():
            chunks[seq // self.chunk][seq] = frame
        held.clear()
        before = walk.waiting
        for number, frames in chunks.items():
            stored = self._chunk(walk, number) if before else {}
            for seq in frames.keys() & stored.keys():
                walk.too_late(frames[seq])
            together = frames | stored
            walk.waiting += len(together) - len(stored)
            self.waiting.updateValue((number,), (json.dumps(list(together.values())),))

    def _without_missing(self, walk: Walk) -> Iterator[pd.DataFrame]:
        """Take all frames that wait, in order, an entry at a time."""
        few = self._few(walk)
        for seq in sorted(few):
            walk.step(few[seq])
        for number in sorted(k[0] for k in list(self.waiting.keys())) if walk.waiting else ():
            stored = self._chunk(walk, number)
            self._take(walk, number, stored)
            for seq in sorted(stored):
                walk.step(stored[seq])
            if len(walk.out) >= GIVEN:
                yield self._given(walk)

    def close(self) -> None:
        pass


PACKED = pd.Index(["whole", "broken"])


class PackedTracker(BarTracker):
    """The same on tables with two lists a row."""

    def _read(self, batch: pd.DataFrame):
        frames, latest = [], 0
        for whole, broken in zip(batch["whole"].tolist(), batch["broken"].tolist()):
            (frame, seq, arrived, *rest), (dx, dy, *keys) = whole.tolist(), broken.tolist()
            n = len(keys)
            # a missing number among whole ones has made all of them floats
            frames.append([int(frame), int(seq), dx, dy, rest[:n], keys, rest[n:2 * n], rest[2 * n:]])
            latest = max(latest, arrived)
        return frames, int(latest)

    def _given(self, walk: Walk) -> pd.DataFrame:
        whole, broken = [], []
        for clip, frame, det_id, cx, cy, x, y, stable_x, stable_y, late_frames, late in walk.out:
            whole += (clip, frame, det_id, cx, cy, late_frames, int(late))
            broken += (x, y, stable_x, stable_y)
        walk.out = []
        cells = np.empty((1, 2), object)  # taken as it is, which is quicker than lists of lists
        cells[0, 0], cells[0, 1] = whole, broken
        return pd.DataFrame(cells, columns=PACKED)


def _packed(rows: DataFrame) -> DataFrame:
    ids, keys, xs, ys = [F.coalesce(name, F.array()) for name in OPTIONS]
    return rows.select(
        "clip_id",
        F.concat(F.array(*[F.col(c).cast("bigint") for c in ("frame", "seq")],
                         F.unix_millis(F.col("arrived").cast("timestamp"))), ids, xs, ys).alias("whole"),
        F.concat(F.array("shake_dx", "shake_dy"), keys).alias("broken"), "arrived")


def _unpacked(given: DataFrame) -> DataFrame:
    cells = ", ".join([
        *[f"'{name}', whole[i * {len(WHOLE)} + {n}]" for n, name in enumerate(WHOLE)],
        *[f"'{name}', nullif(broken[i * {len(BROKEN)} + {n}], double('NaN'))"
          for n, name in enumerate(BROKEN)]])
    rows = given.selectExpr(f"""inline(transform(
        sequence(0, CAST(size(broken) / {len(BROKEN)} AS INT) - 1), i -> named_struct({cells})))""")
    return rows.withColumn("late", F.col("late") == 1).select(*OUTPUT)


def _tracked(rows: DataFrame, numbered: bool) -> DataFrame:
    return _unpacked(_packed(rows).groupBy("clip_id").transformWithStateInPandas(
        PackedTracker(numbered), PACKED_DDL, "append", "EventTime"))


def track_endcap_stream(rows: DataFrame, patience: str = PATIENCE) -> DataFrame:
    """Chosen bar and running shake for a stream in the layout of `frame_stream`.

    ``arrived`` says when a row was delivered; without that column it is when Spark reads it.
    A clip's missing frames are given up once rows arrive that are later than its last by
    more than ``patience``.  Bound a micro-batch at the source (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``).  Rows with ``late`` set hold a late frame's number and nothing
    else of note.
    """
    if "arrived" not in rows.columns:
        rows = rows.withColumn("arrived", F.current_timestamp())
    return _tracked(rows.withWatermark("arrived", patience), numbered=True)


def run_available(
    rows: DataFrame, path: str, checkpoint: str, patience: str = PATIENCE, tracked=None,
) -> int:
    """Work off everything the source holds now; late frames go to ``late=true`` below ``path``.

    Returns how many rows came too late for the watermark, which are in neither folder.
    """
    tracked = track_endcap_stream(rows, patience) if tracked is None else tracked
    spark = rows.sparkSession
    # a partitioned sink needs rows in Spark's own form, which a projection makes of them
    split = tracked.withColumn("late", F.coalesce("late", F.lit(False)))
    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, STORE)  # map state and timers need it; read when a query starts
    try:
        query = (
            split.writeStream.format("parquet").outputMode("append")
            .partitionBy("late").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))
    finally:
        if before is None:
            spark.conf.unset(STORE_KEY)
        else:
            spark.conf.set(STORE_KEY, before)
    query.awaitTermination()
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for operator in progress["stateOperators"])
