"""Packing documents into sequences of bounded length by linear grouping and best fit.

Only the number of pieces of each length matters for where pieces go, and there are no more
lengths than tokens in a sequence.  So Spark counts lengths, the driver plans on that
histogram, and Spark deals the pieces out by their rank among pieces of equal length.

The plan: long pieces, sorted, are cut into groups of equal cardinality and rounded up to
the longest of their group.  For those few sizes configurations (which sizes share a
sequence) are chosen, the most constrained size first, each filled up as well as the rest
allows.  Then actual pieces of the groups take the places, and short pieces go, longest
first, where they fit best.  The plan's size depends on the number of lengths and groups,
not on the number of documents.

Defined cases: NULL text is the empty text, one piece with the end id alone.  Texts longer
than a sequence are cut; all their pieces but the last are full.  Repeated rows, also with
equal or NULL doc_id, are packed as often as they occur.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import sys
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import batches_of
from liftengine.llm.tokens import encoder, slices
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS = 96
# documents sent to a Python worker at a time
BATCH_ROWS = 1000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_TYPES = {"int": pa.int32(), "bigint": pa.int64()}


def _batch(schema: str, columns) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, _TYPES[k])
         for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def cut(docs: DataFrame, size: int, vocabulary: str, end: int) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                flat, starts = own.encode(part.column("text"), end)
                flat = memoryview(flat.astype("<u4").tobytes())
                lengths = np.diff(starts)
                each = -(-lengths // size)
                doc = np.repeat(np.arange(len(each)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                first = starts[:-1][doc] + piece * size
                long = np.minimum(lengths[doc] - piece * size, size)
                yield _batch(PIECES, [
                    part.column("doc_id").take(pa.array(doc)), piece, piece * size, long,
                    [zlib.crc32(flat[4 * a:4 * (a + n)]) for a, n in zip(first, long)]])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


@dataclass
class Run:
    """Sequences in a row that hold pieces of the same lengths in the same order."""

    first: int
    count: int
    used: int


@dataclass
class Plan:
    """Where the pieces of each length go.

    An entry (length, rank, bins, per, sequence, offset) places pieces with ranks from
    ``rank`` on, ``per`` to a sequence, into ``bins`` sequences from ``sequence`` on.
    """

    size: int
    entries: list = field(default_factory=list)
    sequences: int = 0
    by_gap: dict = field(default_factory=dict)
    gaps: list = field(default_factory=list)

    def new(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def put(self, run: Run, length: int, rank: int, per: int = 1) -> None:
        self.entries.append((length, rank, run.count, per, run.first, run.used))
        run.used += per * length

    def store(self, run: Run) -> None:
        gap = self.size - run.used
        if gap and run.count:
            if gap not in self.by_gap:
                bisect.insort(self.gaps, gap)
                self.by_gap[gap] = []
            self.by_gap[gap].append(run)

    def best(self, length: int) -> Run | None:
        """Sequences with the smallest gap that the length fits into."""
        at = bisect.bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        run = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[at]
        return run


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list]:
    """Lengths with counts, longest first, as groups of equal cardinality.

    A group is a list of [length, rank, count]; a length may lie in two groups.
    """
    total = sum(n for _, n in large)
    each, out, room = -(-total // groups), [], 0
    for length, n in large:
        rank = 0
        while rank < n:
            if not room:
                out.append([])
                room = each
            took = min(room, n - rank)
            out[-1].append([length, rank, took])
            rank, room = rank + took, room - took
    return out


def _configurations(sizes: np.ndarray, counts: np.ndarray, size: int):
    """(places, how often): the largest size left, with the pair or single that fills best."""
    counts = counts.copy()
    while counts.any():
        lead = int(np.flatnonzero(counts)[0])
        left = counts.copy()
        left[lead] -= 1
        room, best = size - sizes[lead], (0, ())
        fits = np.flatnonzero((left > 0) & (sizes <= room))
        if len(fits):
            best = (sizes[fits[0]], (int(fits[0]),))
            pairs = sizes[fits][:, None] + sizes[fits][None, :]
            pairs = np.where(pairs <= room, pairs, 0)
            np.fill_diagonal(pairs, np.where(left[fits] > 1, np.diag(pairs), 0))
            if (most := pairs.max()) > best[0]:
                a, b = np.unravel_index(pairs.argmax(), pairs.shape)
                best = (most, (int(fits[a]), int(fits[b])))
        places = (lead, *best[1])
        need = np.bincount(places, minlength=len(sizes))
        often = int((counts[need > 0] // need[need > 0]).min())
        counts -= often * need
        yield places, often


def plan(histogram: dict[int, int], size: int, groups: int = GROUPS) -> Plan:
    """Places for all pieces; ``histogram`` has the number of pieces of each length."""
    made = Plan(size)
    if histogram.get(size):
        made.put(made.new(histogram[size]), size, 0)
    ordered = sorted(((x, n) for x, n in histogram.items() if x < size), reverse=True)
    grouped = _grouped([x for x in ordered if x[0] > size // 4], groups)
    sizes = np.array([g[0][0] for g in grouped], np.int64)
    counts = np.array([sum(x[2] for x in g) for g in grouped], np.int64)
    for places, often in _configurations(sizes, counts, size):
        while often:
            # as many sequences as the actual lengths at the heads of the groups last
            need = [places.count(p) for p in places]
            took = min(often, *[max(1, grouped[p][0][2] // n) for p, n in zip(places, need)])
            took = 1 if any(grouped[p][0][2] < n for p, n in zip(places, need)) else took
            run = made.new(took)
            for p in places:
                head = grouped[p][0]
                made.put(run, head[0], head[1])
                head[1], head[2] = head[1] + took, head[2] - took
                if not head[2]:
                    grouped[p].pop(0)
            made.store(run)
            often -= took
    for length, n in ordered:
        if length > size // 4:
            continue
        rank = 0
        while rank < n:
            run = made.best(length)
            per = (size - run.used if run else size) // length
            bins = (n - rank) // per
            if run is None:
                run = made.new(max(1, bins))
            if bins:
                if bins < run.count:
                    made.store(Run(run.first + bins, run.count - bins, run.used))
                    run.count = bins
            else:  # the last few of this length
                made.store(Run(run.first + 1, run.count - 1, run.used))
                run.count, per = 1, n - rank
            made.put(run, length, rank, per)
            rank += run.count * per
            made.store(run)
    return made


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank among all of their length.

    A length may be that of most pieces, so it is numbered in many parts.
    """
    parts = max(64, pieces.count() // 10_000_000)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                             F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    return dealt.withColumn("at", F.row_number().over(within) - 1).join(
        bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("at")).drop(
        "part", "base", "at")


def pack(docs: DataFrame, size: int, vocabulary: str, end: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        pieces = write_scratch(cut(docs, size, vocabulary, end), "pieces")
    histogram = dict(pieces.groupBy("length").count().collect())  # at most ``size`` rows
    entries = np.array(sorted(plan(histogram, size).entries) or [(0,) * 6], np.int64)
    keys = entries[:, 0] << 44 | entries[:, 1]
    schema = PIECES + ", sequence_id bigint, offset bigint"

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            _, first, _, per, sequence, offset = entries[at].T
            sequence = sequence + (rank - first) // per
            offset = offset + (rank - first) % per * length
            yield _batch(schema, [*[batch.column(c) for c in (
                "doc_id", "piece", "start", "length", "ids_crc32")], sequence, offset])

    return _ranked(pieces).mapInArrow(placed, schema)
