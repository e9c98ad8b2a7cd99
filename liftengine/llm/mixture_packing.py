"""Packing documents so that every training window has its sources in target proportions.

Sources are queues of tokens, served by deficit round-robin.  In each round a queue is given
credit for its share of a quarter window and sends as many bursts of ``BURST`` tokens as it
covers; what is left over is its deficit and is carried on, over rounds, windows and tasks.
Rounds follow one another without a gap, and their tokens are cut into windows.  A queue
that has run out is passed over, so the others fill the windows in their own proportions.
By default a source's share is its share of all tokens; then all queues end together and
every window holds what the corpus holds, up to two bursts per source and its share of a round.

After r rounds a queue has sent the bursts that r times its quantum covers, whatever the
other queues do.  So its carried deficit at any round is known without playing the rounds
before, and each task places its own documents: the round of a token follows from its place
in its queue, and its window from what all queues have sent by then.

The windows are full but for the last tokens, fewer than a window, which are cut into
sequences of powers of two: those need no padding either.

Texts are encoded once; ids go to a scratch table with each document's place among its
source's tokens of that task.  A source's tokens are added up per task before any window,
so a source may hold most of the corpus.  Shares are known to every task: one row per queue.
There are at most ``QUEUES`` queues; where there are more sources, several share a queue.

Defined cases: NULL text is the empty text, which is the end id alone.  NULL is a source of
its own.  Repeated rows, also with equal or NULL doc_id, are packed as often as they occur.
Very long documents are cut as freely as others.  A source without a weight, or with a weight
of 0, comes behind all others.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.tokens import slices
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048
BURST = 64
ROUNDS_PER_WINDOW = 4
QUEUES = 4096
# (queue, round) pairs looked at together
_CELLS = 1 << 20

_CODED = "doc_id bigint, source string, part int, start bigint, n bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
_open: dict = {}


# --- encoding ----------------------------------------------------------------------

class ByteEncoder:
    """Ids of a byte-level vocabulary file of the tokenizers library.

    Ordinary texts are encoded by tiktoken, which has the same vocabulary as ranks and gives
    the same ids several times as fast.  Texts that may hold a special token, or a run that
    its regular expressions are not made for, go to the tokenizers library itself.
    """

    ODD = r"<\||\s{256}"

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=pattern, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs})

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD).to_pylist()
        return [np.array([*(self.whole.encode(text, add_special_tokens=False).ids if special
                            else self.fast.encode_ordinary(text)), end], "<u4")
                for text, special in zip(texts.to_pylist(), odd)]


def encoder(*files: str) -> ByteEncoder:
    """The process's encoder for a vocabulary: its file, its ranks and their pattern."""
    if files not in _open:
        _open[files] = ByteEncoder(*files)
    return _open[files]


def _encoded(docs: DataFrame, files: tuple[str, str, str], end: int) -> DataFrame:
    """Every document's ids (two or four bytes each) and its place in its source and task."""

    def rows(batches):
        own, part, ahead = encoder(*files), TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch):
                ids = own.encode(some.column("text"), end)
                starts = []
                for source, one in zip(some.column("source").to_pylist(), ids):
                    starts.append(ahead.get(source, 0))
                    ahead[source] = starts[-1] + len(one)
                narrow = [one.astype("<u2") if one.max() < 1 << 16 else one for one in ids]
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("source"),
                    pa.array(np.full(len(ids), part, np.int32)), pa.array(starts, pa.int64()),
                    pa.array([len(one) for one in ids], pa.int64()),
                    pa.array([one.tobytes() for one in narrow], pa.binary()),
                ], names=["doc_id", "source", "part", "start", "n", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(rows, _CODED)


# --- rounds ------------------------------------------------------------------------

class Rounds:
    """What queues of ``tokens`` each have sent after any round, given their quanta."""

    def __init__(self, tokens: np.ndarray, quanta: np.ndarray, burst: int):
        self.tokens, self.quanta, self.burst = tokens, quanta, burst

    def sent(self, queue, rounds):
        """Tokens sent by ``queue`` in the first ``rounds`` rounds (arrays of one shape)."""
        credit = rounds * self.quanta[queue]
        bursts = np.floor(credit / self.burst).astype(np.int64) * self.burst
        return np.where(credit >= self.tokens[queue], self.tokens[queue],
                        np.minimum(bursts, self.tokens[queue]))

    def of(self, queue, place):
        """The round that sends the token at ``place``: the first whose credit covers it."""
        end = np.minimum((place // self.burst + 1) * self.burst, self.tokens[queue])
        turn = np.ceil(end / self.quanta[queue])
        # division and multiplication round; sent() alone says what goes when
        for _ in range(2):
            turn = np.where(self.sent(queue, turn - 1) > place, turn - 1, turn)
        for _ in range(2):
            turn = np.where(self.sent(queue, turn) <= place, turn + 1, turn)
        return turn

    def before(self, queue, rounds):
        """Tokens sent by all queues before ``queue`` has its turn in each of ``rounds``."""
        distinct, back = np.unique(rounds, return_inverse=True)
        out = np.empty(len(rounds), np.int64)
        everyone = np.arange(len(self.tokens))[:, None]
        step = max(1, _CELLS // len(self.tokens))
        for a in range(0, len(distinct), step):
            some = distinct[None, a:a + step]
            earlier = self.sent(everyone, some - 1)
            own = self.sent(everyone, some) - earlier
            ahead = np.cumsum(own, axis=0) - own + earlier.sum(axis=0)
            here = (back >= a) & (back < a + step)
            out[here] = ahead[queue[here], back[here] - a]
        return out

    def runs(self, queue, start, n):
        """Stretches of documents as they follow in the output: (document, place, length, at)."""
        first, last = start // self.burst, (start + n - 1) // self.burst
        each = last - first + 1
        doc = np.repeat(np.arange(len(n)), each)
        burst = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each - first, each)
        q = queue[doc]
        turn = self.of(q, np.maximum(burst * self.burst, start[doc]))
        low = np.maximum(burst * self.burst, start[doc])
        new = np.flatnonzero(np.diff(doc, prepend=-1) | (np.diff(turn, prepend=-1) != 0))
        doc, q, turn, low = doc[new], q[new], turn[new], low[new]
        high = np.append(low[1:], 0)
        ends = np.append(doc[1:] != doc[:-1], True)
        high = np.where(ends, start[doc] + n[doc], high)
        at = self.before(q, turn) + low - self.sent(q, turn - 1)
        # a burst may follow its predecessor at once
        joins = np.append(False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + (high - low)[:-1]))
        heads = np.flatnonzero(~joins)
        return doc[heads], low[heads], np.add.reduceat(high - low, heads), at[heads]


def _cut(doc, place, length, at, window: int, total: int):
    """Stretches cut at the ends of sequences: also which sequence, and the offset there."""
    full = total // window
    rest = total % window
    tail = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    bounds = full * window + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)

    def sequence(where):
        return np.where(where < full * window, where // window,
                        full + np.searchsorted(bounds, where, side="right") - 1)

    def begin(number):
        return np.where(number < full, number * window,
                        bounds[np.clip(number - full, 0, len(bounds) - 1)])

    first, last = sequence(at), sequence(at + length - 1)
    each = last - first + 1
    of = np.repeat(np.arange(len(doc)), each)
    number = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    low = np.maximum(at[of], begin(number))
    high = np.minimum(at[of] + length[of], begin(number + 1))
    return doc[of], place[of] + low - at[of], high - low, number, low - begin(number)


# --- over a table ------------------------------------------------------------------

def _quanta(totals: list, weights: dict | None, each: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and credit per round of each queue; ``totals`` has (queue, source, tokens).

    Credits of a round add up to ``each``.
    """
    tokens = np.array([t for *_, t in totals], np.int64)
    shares = tokens.astype(float) if weights is None else np.array(
        [float(weights.get(source, 0)) for _, source, _ in totals])
    quanta = each * shares / max(shares.sum(), 1e-300)
    # behind all others: credit that comes to a burst only when they have sent everything
    served = quanta > 0
    longest = max((tokens[served] / quanta[served]), default=1.0) + 2
    return tokens, np.where(served, quanta, BURST / 2 / longest)


def pack(docs: DataFrame, files: tuple[str, str, str], end: int, window: int = WINDOW,
         burst: int = BURST, weights: dict | None = None) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    ``files`` are a vocabulary file, the same vocabulary as ranks, and the pattern that splits
    texts for these.  ``weights`` are target proportions of tokens by source; the corpus's own
    by default.
    """
    spark = docs.sparkSession
    coded = write_scratch(_encoded(docs, files, end), "ids")
    parts = write_scratch(coded.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    by_code = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    queues = write_scratch(parts.groupBy("source").agg(F.sum("n").alias("tokens")).withColumn(
        "queue", F.pmod(F.row_number().over(by_code) - 1, F.lit(QUEUES)).cast("int")), "queues")
    before = Window.partitionBy("queue").orderBy("s", "p").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "n").join(
        queues, F.col("s").eqNullSafe(F.col("source"))).select(
        "s", "p", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = queues.groupBy("queue").agg(
        F.min("source").alias("source"), F.sum("tokens").alias("n")).orderBy("queue").collect()
    tokens, quanta = _quanta(totals, weights, window / ROUNDS_PER_WINDOW)
    rounds, total = Rounds(tokens, quanta, burst), int(tokens.sum())

    def placed(batches):
        for batch in batches:
            queue, start, n, base = (
                batch.column(c).to_numpy() for c in ("queue", "start", "n", "base"))
            doc, place, length, sequence, offset = _cut(
                *rounds.runs(queue, start + base, n), window, total)
            own = place - (start + base)[doc]
            crcs, ids, held = [], batch.column("ids"), -1
            for d, a, k in zip(doc.tolist(), own.tolist(), length.tolist()):
                if d != held:
                    raw, held = ids[d].as_buffer(), d
                    wide = np.frombuffer(raw, "<u2" if raw.size == 2 * n[d] else "<u4")
                    view = memoryview(wide.astype("<u4").tobytes())
                crcs.append(zlib.crc32(view[4 * a:4 * (a + k)]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc)), pa.array(own), pa.array(length),
                pa.array(crcs, pa.int64()), pa.array(n[doc]), pa.array(sequence),
                pa.array(offset)], names=[c.split()[0] for c in PIECES.split(", ")])

    if not total:
        return spark.createDataFrame([], PIECES)
    return coded.join(bases, F.col("source").eqNullSafe(F.col("s")) & (
        F.col("part") == F.col("p"))).select(
        "doc_id", "queue", "start", "n", "ids", "base").mapInArrow(placed, PIECES)
