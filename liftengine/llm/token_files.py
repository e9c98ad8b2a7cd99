"""Token ids in flat binary files that training jobs map into memory.

Format, below one folder of a file system that driver and executors share:

* ``part-NNNNNN.bin``  ids of the part's documents, little-endian unsigned integers, no header;
  16 bits each where all ids of the vocabulary fit, else 32
* ``part-NNNNNN.idx``  n document ids, then n + 1 offsets, little-endian signed 64-bit;
  offsets count ids from the start of the whole corpus
* ``manifest/``        Parquet: part, docs, tokens, width (bytes per id), base (ids in all
  parts before)

Documents are dealt into parts by ranges of doc_id and sorted within, so parts in order hold
ascending ids.  A part's base is the prefix sum of the counts of the parts before it, one
row per part.  Files are written under a name of the attempt and then renamed, so a task
that is run again, or twice, leaves the same files.

Defined cases: NULL text is the empty text (only the end id); NULL doc_id comes first and is
stored as the smallest 64-bit integer; equal ids are ordered by text and stay separate
documents.  An empty table gives an empty manifest.  Other columns are not read.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftengine.llm.tokens import encoder, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_ID = -(1 << 63)
PART = "part int, docs bigint, tokens bigint, width int"


def _store(path: str):
    """The file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _put(store, name: str, chunks) -> None:
    """Write a file whole or not at all."""
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(draft, name)


def _get(store, name: str) -> memoryview:
    """A file's bytes, mapped into memory where it is a file of this machine."""
    if isinstance(store, fs.LocalFileSystem):
        if os.path.getsize(name) == 0:
            return memoryview(b"")
        return memoryview(pa.memory_map(name).read_buffer())
    with store.open_input_file(name) as file:
        return memoryview(file.read_buffer())


def _rows(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], kinds[k]) for n, k in (f.split() for f in schema.split(", "))],
        names=list(columns))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int) -> DataFrame:
    """Encode the documents into files below ``path``; returns the manifest."""
    spark = docs.sparkSession

    def encoded(batches):
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        own = encoder(vocabulary)
        width = own.width(end)
        ids, sizes = [], []

        def chunks():
            for batch in batches:
                for piece in slices(batch):
                    flat, starts = own.encode(piece.column("text"), end)
                    ids.append(pc.fill_null(piece.column("doc_id"), NO_ID).to_numpy())
                    sizes.append(np.diff(starts))
                    yield flat.astype(f"<u{width}").tobytes()

        _put(store, f"{folder}/part-{part:06d}.bin", chunks())
        all_ids = np.concatenate([np.empty(0, "<i8"), *ids]).astype("<i8")
        all_sizes = np.concatenate([np.empty(0, "<i8"), *sizes]).astype("<i8")
        _put(store, f"{folder}/part-{part:06d}.len", [all_ids.tobytes(), all_sizes.tobytes()])
        yield _rows(PART, part=[part], docs=[len(all_ids)], tokens=[int(all_sizes.sum())],
                    width=[width])

    order = F.col("doc_id").asc_nulls_first()
    parts = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(
        order, "text").mapInArrow(encoded, PART)
    parts.write.parquet(f"{path}/counts")
    counted = spark.read.parquet(f"{path}/counts")
    # one row per file: the prefix sums are over as many rows as there are files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def indexed(batches):
        store, folder = _store(path)
        for batch in batches:
            for part, docs_in, base in zip(*(batch.column(c).to_pylist()
                                             for c in ("part", "docs", "base"))):
                held = np.frombuffer(_get(store, f"{folder}/part-{part:06d}.len"), "<i8")
                offsets = base + np.concatenate([[0], np.cumsum(held[docs_in:])])
                _put(store, f"{folder}/part-{part:06d}.idx",
                     [held[:docs_in].tobytes(), offsets.astype("<i8").tobytes()])
            yield batch

    based.repartition(max(1, counted.count())).mapInArrow(
        indexed, PART + ", base bigint").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    step = 10_000

    def mapped(batches):
        store, folder = _store(path)
        for batch in batches:
            for part, n, width in zip(*(batch.column(c).to_pylist()
                                        for c in ("part", "docs", "width"))):
                index = np.frombuffer(_get(store, f"{folder}/part-{part:06d}.idx"), "<i8")
                ids, offsets = index[:n], index[n:]
                flat = np.frombuffer(_get(store, f"{folder}/part-{part:06d}.bin"), f"<u{width}")
                places = offsets - offsets[0]
                for a in range(0, n, step):
                    b = min(n, a + step)
                    out = _rows(
                        schema, doc_id=pa.array(ids[a:b], mask=ids[a:b] == NO_ID),
                        start=offsets[a:b], n_tokens=np.diff(offsets[a:b + 1]),
                        ids_crc32=[zlib.crc32(flat[places[i]:places[i + 1]].astype("<u4"))
                                   for i in range(a, b)])
                    yield out

    parts = spark.read.parquet(f"{path}/manifest")
    return parts.repartition(max(1, parts.count())).mapInArrow(mapped, schema)
