"""Short codes for vectors: parts of a vector named by the nearest entry of a codebook.

Components become integers, vectors are cut into equal parts, and every part position has a
codebook of a few entries, fitted in rounds over all vectors: each part goes to its nearest
entry, and each entry to the mean of its parts.  A round is one pass; tasks add up counts and
sums per entry, and the driver sees those alone (parts x entries rows).

The nearest entry is found in a tree over the codebook (GNAT).  A node has split points, far
from one another; every other entry of the node is a child of its nearest split point.  For
each split point and child the node keeps the range of distances between them.  With the
distance of a query to a split point, a child is ruled out with all below it if its whole
range is farther from that distance than the best entry so far.  Distances in these
tests are whole numbers rounded so that a child is kept in doubt, and it is ruled out only if
it is strictly farther, so no entry at the same distance is lost.  What decides is the integer
squared distance, and the lower index between equal ones.

Defined cases: vectors that are NULL, or hold NULL or a component that is not finite, are left
out.  Shorter vectors count as ending in zeros, up to the longest one's length, rounded up to
a multiple of the parts.  Integers beyond 2^24 in size (components beyond 4,096) count as
2^24, so that sums of 4,096 squares fit; sums over vectors are decimals.  The starting entries are
the vectors with the least ids, NULL ids last, and of equal ids those with the least
components; with fewer vectors than entries there are as many entries as vectors.  Repeated
rows count as often as they occur.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 24
DEGREE = 4
_SUMS = "part int, entry int, n bigint, sums array<bigint>"
# vectors that are looked at together
_ROWS = 8192


# --- the tree ------------------------------------------------------------------------

def _squares(a, b):
    return ((a - b) ** 2).sum(axis=-1)


def _under(square):
    """A whole number that is not above the root of ``square``; doubles err by one at most."""
    return np.maximum(np.floor(np.sqrt(square)).astype(np.int64) - 1, 0)


def _over(square):
    """A whole number that is not below the root of ``square``."""
    return np.ceil(np.sqrt(square)).astype(np.int64) + 1


class Gnat:
    """A node over the entries with the given indices."""

    def __init__(self, entries: np.ndarray, own=None, degree: int = DEGREE):
        own = list(range(len(entries))) if own is None else own
        self.entries, self.splits = entries, self._far_apart(entries, own, degree)
        rest = [i for i in own if i not in self.splits]
        nearest = [min(range(len(self.splits)), key=lambda j: (
            _squares(entries[i], entries[self.splits[j]]), j)) for i in rest]
        members = [[i for i, j in zip(rest, nearest) if j == child]
                   for child in range(len(self.splits))]
        # low[i, j] and high[i, j]: from split point i to all of child j, its split point too
        shape = (len(self.splits), len(self.splits))
        self.low, self.high = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for j, below in enumerate(members):
            group = entries[[self.splits[j], *below]]
            for i, split in enumerate(self.splits):
                away = _squares(group, entries[split])
                self.low[i, j], self.high[i, j] = _under(away.min()), _over(away.max())
        self.children = [Gnat(entries, below, degree) if below else None for below in members]

    @staticmethod
    def _far_apart(entries, own, degree):
        """Split points: the first entry, then always the one farthest from those chosen."""
        chosen = own[:1]
        away = _squares(entries[own], entries[chosen[0]])
        while len(chosen) < min(degree, len(own)):
            away[[own.index(c) for c in chosen]] = -1
            chosen = [*chosen, own[int(away.argmax())]]
            away = np.minimum(away, _squares(entries[own], entries[chosen[-1]]))
        return chosen

    def search(self, queries: np.ndarray, best: np.ndarray, index: np.ndarray,
               rows: np.ndarray | None = None) -> int:
        """Lower ``best`` (squares) and ``index`` to the nearest entry; distances computed."""
        rows = np.arange(len(queries)) if rows is None else rows
        open_ = np.ones((len(rows), len(self.splits)), bool)
        done = 0
        for i, split in enumerate(self.splits):
            # a split point whose child is ruled out need not be looked at either
            at = np.flatnonzero(open_[:, i])
            if not len(at):
                continue
            ask = rows[at]
            square = _squares(queries[ask], self.entries[split])
            done += len(at)
            nearer = (square < best[ask]) | ((square == best[ask]) & (split < index[ask]))
            best[ask[nearer]], index[ask[nearer]] = square[nearer], split
            reach = _over(best[ask])[:, None]
            out = ((_under(square)[:, None] - reach > self.high[i])
                   | (_over(square)[:, None] + reach < self.low[i]))
            open_[at] &= ~out
        for j, child in enumerate(self.children):
            if child is not None and len(at := np.flatnonzero(open_[:, j])):
                done += child.search(queries, best, index, rows[at])
        return done


@dataclass
class Codebooks:
    """``entries``[part, entry, place]: integers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part of each vector."""
        shape = (len(vectors), len(self.entries))
        chosen, errors = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        if vectors.size:
            for part, tree in enumerate([Gnat(book) for book in self.entries]):
                best = np.full(len(vectors), np.iinfo(np.int64).max >> 2)
                index = np.full(len(vectors), len(self.entries[0]))
                tree.search(vectors[:, part], best, index)
                chosen[:, part], errors[:, part] = index, best
        return chosen, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# --- over a table ----------------------------------------------------------------------

def _integers(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows of integers, ending in zeros."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    flat = flat[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -LARGEST, LARGEST).astype(np.int64)


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite: vec_id, label, v."""
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", F.col(column).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & fine)


def _in_parts(batch, name: str, parts: int, width: int):
    lists = batch.column(name)
    for a in range(0, len(lists), _ROWS):
        rows = batch.slice(a, _ROWS)
        yield rows, _integers(rows.column(name), parts * width).reshape(len(rows), parts, width)


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Counts and sums of the parts that go to each entry, added up over all vectors."""
    parts, entries, width = books.entries.shape

    def added(batches):
        count = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)

        def told():
            part, entry = np.indices(count.shape).reshape(2, -1)
            return pa.RecordBatch.from_arrays([
                pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
                pa.array(count.ravel()), pa.array(sums.reshape(-1, width).tolist(),
                                                  pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"])

        for batch in batches:
            for _, rows in _in_parts(batch, "v", parts, width):
                chosen, _ = books.assign(rows)
                for part in range(parts):
                    np.add.at(count[part], chosen[:, part], 1)
                    np.add.at(sums[part], chosen[:, part], rows[:, part])
                if count[0].sum() > 1 << 34:  # sums are still far from 2^63
                    yield told()
                    count[:], sums[:] = 0, 0
        yield told()

    whole = "decimal(38,0)"
    return vectors.select("v").mapInArrow(added, _SUMS).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast(whole)).alias(f"s{i}")
                                 for i in range(width)])


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all of ``vectors`` (as from `kept`); None if there are none."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select(
        "v").toArrow().combine_chunks()
    start = _integers(first.column("v").combine_chunks(), parts * width)
    books = Codebooks(start.reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    for _ in range(rounds if width else 0):
        after = books.entries.copy()
        for part, entry, n, *sums in _sums(vectors, books).collect():  # parts x entries rows
            if n:
                after[part, entry] = [int(s) // n for s in sums]
        books = Codebooks(after)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (the parts' entries in order) and error of each vector."""
    parts, _, width = books.entries.shape
    ddl = vectors.select("vec_id", "label").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ddl)

    def coded(batches):
        for batch in batches:
            for rows, vectors_ in _in_parts(batch, "v", parts, width):
                chosen, errors = books.assign(vectors_)
                yield pa.RecordBatch.from_arrays([
                    rows.column("vec_id"), rows.column("label"),
                    pa.array(chosen.tolist(), pa.list_(pa.int64())),
                    pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(
        coded, f"{schema}, code array<bigint>, error bigint")


def compress(vectors: DataFrame, **how) -> DataFrame:
    """Codes and errors of all vectors, with errors added up by label and the codebooks' hash."""
    spark = vectors.sparkSession
    rows = write_scratch(kept(vectors), "vectors")
    books = fit(rows, **how)
    if books is None:
        empty = rows.select("vec_id", "label").limit(0)
        return empty.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("code", "array<bigint>"), ("error", "bigint"), ("label_error", "bigint"),
            ("codebooks_sha256", "string"))])
    coded = write_scratch(encode(rows, books), "codes")
    summed = coded.groupBy(F.col("label").alias("of")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    return coded.join(summed, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "codebooks_sha256", F.lit(books.sha256()))
