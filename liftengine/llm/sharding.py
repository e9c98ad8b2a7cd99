"""Shards of equal bytes from indivisible groups, by Karmarkar-Karp differencing.

A group is all documents with one text.  A partial partition gives each shard a sum; alone,
a group is one with its size in one shard and nothing in the others.  Again and again the
two partial partitions with the largest spread are combined, the largest sum of one with the
smallest of the other.

Groups are dealt into chunks by the hash of their text.  Each chunk is differenced by a
task and leaves one partial partition of a few dozen sums; these (at most ``CHUNKS``) are
differenced once more on the driver, which only renames each chunk's shards.

Defined cases: NULL text is the empty text, of size 16.  Documents with equal texts share a
shard.  Repeated rows are separate documents of one group.  If one group is larger than a
shard's fair part, its shard holds nothing else of note and the others are level.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import text_of
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OVERHEAD = 16
CHUNKS = 4096


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of sums) into one.

    Returns, for each row, the shard that each of its columns ends up in, and the sums.
    """
    n, k = partials.shape
    if n == 0:
        return np.zeros((0, k), np.int64), np.zeros(k, np.int64)
    order = np.argsort(-partials, axis=1, kind="stable")
    level = np.take_along_axis(partials, order, 1)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(level)]
    heapq.heapify(heap)
    sums = dict(enumerate(level))
    joined = []  # (left, right, where the left's and the right's columns go)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        turn = np.argsort(-both, kind="stable")
        to = np.empty(k, np.int16)
        to[turn] = np.arange(k)
        made = n + len(joined)
        joined.append((a, b, to))
        sums[made] = both[turn]
        heapq.heappush(heap, (-int(both[turn[0]] - both[turn[-1]]), made))
    # from the last combination back to the rows
    (top, final), = sums.items()
    places = {top: np.arange(k)}
    for i in range(len(joined) - 1, -1, -1):
        a, b, to = joined[i]
        place = places.pop(n + i)[to]
        places[a], places[b] = place, place[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = places[i]
    return out, final


def _numbered(docs: DataFrame, rows: int) -> DataFrame:
    """``slot`` from 0 within each shard, numbered in many parts."""
    parts = max(256, rows // 4_000_000)
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "h2", F.lit(3)),
                                           F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "h1", "h2")
    return dealt.withColumn("at", F.row_number().over(within) - 1).join(
        bases, ["shard", "part"]).withColumn("slot", F.col("base") + F.col("at"))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    text = text_of()
    sized = write_scratch(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2")), "sized")
    rows = sized.count()
    chunks = min(CHUNKS, max(1, rows // 2_000))
    groups = sized.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).withColumn(
        "chunk", F.pmod("h1", F.lit(chunks)).cast("int"))

    def differenced(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["bytes", "h1", "h2"], ignore_index=True)
        partials = np.zeros((len(found), shards), np.int64)
        partials[:, 0] = found["bytes"]
        places, sums = difference(partials)
        return pd.DataFrame({
            "h1": found["h1"], "h2": found["h2"], "chunk": found["chunk"],
            "place": places[:, 0].astype(np.int32), "total": sums[places[:, 0]]})

    local = write_scratch(groups.groupBy("chunk").applyInPandas(
        differenced, "h1 bigint, h2 bigint, chunk int, place int, total bigint"), "groups")
    # at most CHUNKS x shards sums
    sums = local.groupBy("chunk", "place").agg(F.first("total").alias("total")).toPandas()
    table = sums.pivot(index="chunk", columns="place", values="total").reindex(
        columns=range(shards)).fillna(0).astype(np.int64).sort_index()
    final, _ = difference(table.to_numpy())
    renamed = pd.DataFrame({
        "chunk": np.repeat(table.index.to_numpy(), shards).astype(np.int32),
        "place": np.tile(np.arange(shards), len(table)).astype(np.int32),
        "shard": final.ravel().astype(np.int32)})
    names = spark.createDataFrame(renamed, "chunk int, place int, shard int")
    placed = local.join(F.broadcast(names), ["chunk", "place"]).select("h1", "h2", "shard")
    return _numbered(sized.join(placed, ["h1", "h2"]), rows).select(
        "doc_id", "size", "text_crc32", "shard", "slot")
