"""Removing long repeated byte strings, exactly, by blockwise suffix sorting.

Each byte of a text goes that a string of ``WINDOW`` bytes covers which also starts earlier.
The suffixes that matter are those at string starts, to a depth of WINDOW bytes.

1. Buckets.  The least hash of the 32-byte grams in a string (the leftmost of equals) anchors
   it.  Equal strings have equal anchors at equal places, so suffixes are dealt into buckets
   by anchor.  Strings in a row with one anchor make a segment; equal segments are settled by
   order alone, first within a batch, then by a window over the bucket.  Segments whose
   anchor is unique have no repeats.  What is left, one row per different segment of a
   bucket, goes on.
2. Blocks.  A task takes its buckets one block after another, each of bounded size.  In a
   block, positions in a difference cover (mod 57) are ranked by their suffixes first.
   Then the suffixes of each bucket are sorted by their first bytes, up to the next cover
   position, and by its rank from there on: long ties cost one look-up.  Neighbours with
   equal strings form runs; all but the earliest of a run are repeats.
3. The repeats of each document are joined to its text once more and cut out.

What the driver holds does not depend on the data.  No step depends on how often a string
occurs but the last block of its bucket, which holds a row per *different* surrounding.

Defined cases: NULL text is the empty text; texts shorter than WINDOW lose nothing.
Documents are ordered by doc_id, NULL last.  Where ids repeat or are NULL, rows are told
apart by a number in the order of (doc_id, text), so of repeated rows the first is kept
whole.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import text_of
from liftengine.llm.tokens import slices
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM + 1
#: Every difference mod 57 is a difference of two of these.
CYCLE, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: A segment's row in a block: its anchor stands at a multiple of the cycle.
ANCHOR, STRIDE = 2 * CYCLE, 4 * CYCLE
CHUNK = 1 << 19
BLOCK_SEGMENTS = 4_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in np.random.default_rng(8).integers(1 << 62, 1 << 63, 5, np.uint64)
          * np.uint64(2) + np.uint64(1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from each place on, by doubling."""
    h, width = _BYTES[text], 1
    for step in _STEPS:
        h = h[:-width] * step + h[width:]
        width *= 2
    return _mixed(h)


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each run of ``width`` values stands, the leftmost of equals."""
    best, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best = np.where(later, best[step:], best[:-step])
        at = np.where(later, at[step:], at[:-step])
        span += step
    return at


def segments(text: np.ndarray, starts: np.ndarray):
    """Segments of texts that lie one behind another: text number, h, s, lo, hi, at.

    lo and hi are the first and last string start, at is the anchor; all count within the
    text.  h names the anchor's gram, s the whole segment.
    """
    for a in range(0, len(text) - WINDOW + 1, CHUNK):
        part = text[a:a + CHUNK + WINDOW - 1]
        h = gram_hashes(part)
        at = leftmost_least(h, SPAN)
        place = a + np.arange(len(at))
        own = np.searchsorted(starts, place, side="right") - 1
        inside = place + WINDOW <= starts[own + 1]
        new = np.diff(at, prepend=-1) != 0
        new[1:] |= (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        first, last = first[inside[first]], last[inside[first]]
        end = last + WINDOW - GRAM
        s = _mixed(h[first] ^ (end - first).astype(np.uint64))
        for step in (32, 64, 96, 128, 160):
            s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(first + step, end)])
        number, anchor = own[first], at[first]
        s = _mixed(s ^ (anchor - first).astype(np.uint64))
        shift = a - starts[number]
        yield number, h[anchor], s, first + shift, last + shift, anchor + shift


def _merged(key, lo, hi):
    """Intervals of string starts, joined where they touch within a document."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    return key[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi[:0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends)."""
    column = column.cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[starts[0]:starts[-1]], starts - starts[0]


_SENT = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()),
                   ("hi", pa.int32()), ("at", pa.int32()), ("known", pa.bool_())])


def _sent(h, s, key, lo, hi, at, known) -> pa.RecordBatch:
    columns = [h.view(np.int64), s.view(np.int64), key, lo, hi, at, np.full(len(key), known)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c).cast(f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _find(batches):
    """Segments of a task's texts; repeats of a segment within a batch are known at once."""
    for batch in batches:
        raw, starts = _bytes_of(batch.column("text"))
        keys = batch.column("key").to_numpy()
        # texts of about a chunk together
        group = starts[:-1] // (2 * CHUNK)
        bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for a, b in zip(bounds[:-1], bounds[1:]):
            base = starts[a]
            found = list(segments(raw[base:starts[b]], starts[a:b + 1] - base))
            if not found:
                continue
            number, h, s, lo, hi, at = (np.concatenate(x) for x in zip(*found))
            key = keys[a:b][number]
            order = np.lexsort((lo, key, s, h))
            h, s, key, lo, hi, at = (x[order] for x in (h, s, key, lo, hi, at))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            yield _sent(*(x[first] for x in (h, s, key, lo, hi, at)), False)
            key, lo, hi = _merged(key[~first], lo[~first], hi[~first])
            if len(key):  # dealt anywhere
                place = _mixed(key.view(np.uint64) ^ _mixed(lo.astype(np.uint64)))
                yield _sent(place, place, key, lo, hi, lo, True)


_OPEN = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
                   ("at", pa.int32()), ("bytes", pa.binary())])
_FOUND = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _cut(batches):
    """The bytes of the segments that are left."""
    for batch in batches:
        lists = batch.column("open")
        for i, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"))):
            raw = text.as_py().encode()
            rows = lists[i].as_py()
            yield pa.RecordBatch.from_arrays([
                pa.array([r["h"] for r in rows], pa.int64()),
                pa.array([key] * len(rows), pa.int64()),
                *[pa.array([r[c] for r in rows], pa.int32()) for c in ("lo", "hi", "at")],
                pa.array([raw[r["lo"]:r["hi"] + WINDOW] for r in rows], pa.binary())],
                schema=_OPEN)


def block_repeats(h, key, lo, hi, at, parts: list[bytes]):
    """Starts of repeated strings in a block of whole buckets, as merged intervals."""
    n = len(parts)
    flat = np.zeros(n * STRIDE + STRIDE, np.uint8)
    begin = np.arange(n) * STRIDE + ANCHOR + (lo - at)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes)
    flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])] = np.frombuffer(
        b"".join(parts), np.uint8)
    eights = np.lib.stride_tricks.sliding_window_view(flat, 8)

    def word(place):
        return eights[place].view(">u8")[:, 0].astype(np.uint64)

    counts = hi - lo + 1
    row = np.repeat(np.arange(n), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    place, start = begin[row] + step, lo[row] + step
    column = place - row * STRIDE
    # ranks of the cover positions that some suffix comes to, by their own suffixes
    to_cover = np.array([min((c - i) % CYCLE for c in COVER) for i in range(CYCLE)])
    met = place + to_cover[column % CYCLE]
    cover, back = np.unique(met, return_inverse=True)
    keys = [word(cover + 8 * i) for i in range(WINDOW // 8 + 1)]
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(cover), bool)
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(cover), np.int64)
    rank[order] = np.cumsum(differs)
    # suffixes of each bucket and place: the head up to the cover position, then its rank
    heads = [word(place + 8 * i) for i in range(max(to_cover) // 8 + 1)]
    order = np.lexsort((rank[back], *heads[::-1], column, h[row]))
    same = np.zeros(len(order), bool)
    same[1:] = (h[row][order][1:] == h[row][order][:-1]) & (
        column[order][1:] == column[order][:-1])
    for k in heads:
        same[1:] &= k[order][1:] == k[order][:-1]
    # neighbours with equal heads: are their strings equal to the end?
    pair = np.flatnonzero(same)
    one, two = place[order[pair - 1]], place[order[pair]]
    for i in range(len(heads), WINDOW // 8 + 1):
        spare = np.uint64(8 * max(0, 8 * (i + 1) - WINDOW))
        equal = word(one + 8 * i) >> spare == word(two + 8 * i) >> spare
        same[pair[~equal]] = False
        pair, one, two = pair[equal], one[equal], two[equal]
    # of each run of equal strings the earliest stays
    earliest = np.empty(len(order), np.int64)
    earliest[np.lexsort((start, key[row]))] = np.arange(len(order))
    age = earliest[order]
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(age, np.flatnonzero(~same))
    repeat = order[age != least[run]]
    return _merged(key[row[repeat]], start[repeat], start[repeat])


def _sorted_blocks(batches):
    """Whole buckets of a task's rows, which come in the order of h, block by block."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def done(table: pa.Table):
        columns = [table.column(c).to_numpy() for c in ("h", "key", "lo", "hi", "at")]
        found = block_repeats(*[c.astype(np.int64) for c in columns],
                              table.column("bytes").to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(c).cast(f.type) for c, f in zip(found, _FOUND)], schema=_FOUND)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BLOCK_SEGMENTS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        a = 0
        while len(h) - a >= BLOCK_SEGMENTS:  # the last bucket may go on in the next batch
            b = int(np.searchsorted(h, h[a + BLOCK_SEGMENTS - 1], side="left"))
            if b == a:
                b = int(np.searchsorted(h, h[a], side="right"))
            if b == len(h):
                break
            yield done(table.slice(a, b - a))
            a = b
        held = table.slice(a).to_batches()
        rows = len(h) - a
    if rows:
        yield done(pa.Table.from_batches(held))


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(batches):
    """Each text without the bytes that its repeats cover."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                       batch.column("spans").to_pylist()):
            raw = text.as_py().encode()
            kept, at, n = [], 0, 0
            for a, b in sorted((s["lo"], s["hi"] + WINDOW) for s in spans or ()):
                if a > at or not n:
                    n += 1
                    kept.append(raw[at:a])
                at = max(at, b)
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(raw), len(raw) - len(rest), n,
                        hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)] if out else
            [pa.array([], f.type) for f in _RESULT], schema=_RESULT)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key that orders the documents."""
    plain = docs.select("doc_id", text_of().alias("text"))
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1)
    if odd.isEmpty():
        return plain.where("doc_id is not null").select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    numbered = plain.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return write_scratch(numbered, "numbered").where("key is not null")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every document."""
    keyed = _keyed(docs)
    sent = keyed.select("key", "text").mapInArrow(
        _find, "h bigint, s bigint, key bigint, lo int, hi int, at int, known boolean")
    bucket = Window.partitionBy("h")
    dealt = sent.repartition("h").select(
        "*", F.row_number().over(Window.partitionBy("h", "s").orderBy("key", "lo")).alias("nth"),
        (F.min("s").over(bucket) != F.max("s").over(bucket)).alias("mixed"))
    spans = write_scratch(dealt.where("known or nth > 1 or mixed").select(
        "h", "key", "lo", "hi", "at", (~F.col("known") & (F.col("nth") == 1)).alias("open")), "spans")
    left = spans.where("open").groupBy("key").agg(
        F.collect_list(F.struct("h", "lo", "hi", "at")).alias("open"))
    opened = keyed.select("key", "doc_id", "text").join(left, "key").select(
        "key", "text", "open").mapInArrow(
        _cut, "h bigint, key bigint, lo int, hi int, at int, bytes binary")
    sorted_out = opened.repartition("h").sortWithinPartitions("h").mapInArrow(
        _sorted_blocks, "key bigint, lo int, hi int")
    repeats = spans.where("not open").select("key", "lo", "hi").unionByName(sorted_out).groupBy(
        "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return keyed.join(repeats, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "kept_sha256 string, kept binary")
