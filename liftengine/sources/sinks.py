"""Writing the analysis and the reports, and reading analysis CSVs back."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftengine import schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not install this

# the clip number in the path of a CSV that has no clip_id column
CLIP_IN_PATH = r"clip_id=(\d+)"
# CSVs as they are and as gzip packs them
CSV_FILES = "*.{csv,csv.gz}"
# rows of a compressed file, which one task reads from its start
PACKED_ROWS = 100_000
# fields of all different headers, up to which they are sent to every task
SENT_FIELDS = 1_000_000


def write_analysis(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The analysis table as Parquet, each task's rows in clip and frame order."""
    df.sortWithinPartitions("clip_id", "frame").write.mode(mode).parquet(path)


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ANALYSIS).parquet(path)


def export_analysis_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", clip_folders: bool = False,
    compression: str = "none",
) -> None:
    """CSV files with a header; missing values are empty.

    Files hold many clips each, with ``clip_id`` as their second column, so their number
    follows the data and not the clips.  ``clip_folders`` makes a folder per clip instead;
    choose the clips first.  ``compression`` ``gzip`` makes files ``.csv.gz`` of a bounded number
    of rows, since a compressed file is read by one task.
    """
    rows = df.select("frame", *[c for c in df.columns if c != "frame"])
    writer = rows.sortWithinPartitions("clip_id", "frame").write.mode(mode)
    if clip_folders:
        writer = rows.repartition("clip_id").sortWithinPartitions(
            "clip_id", "frame").write.mode(mode).partitionBy("clip_id")
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", PACKED_ROWS)
    writer.option("header", True).option("emptyValue", "").option(
        "compression", compression).csv(path)


_HEADER = '^"?frame"?(,|$)'  # 'frame' is the index and comes first in every header


def _under_headers(lines: DataFrame) -> DataFrame:
    """Data lines with ``header``: the MD5 of the last header line before them in their file, or NULL.

    Lines come in file order within a split.  A task pairs them as it reads; where a split
    begins in the middle of a file, the header comes from the splits before.  Each such split
    leaves one short row, a file's first split none, so these rows are sent to the lines: Spark
    would take them for as large as the lines, and move and sort all of those.
    """
    marked = lines.withColumn("head", F.when(F.col("value").rlike(_HEADER), F.md5("value")))

    def paired(batches):
        at, own = None, None
        for batch in batches:
            if not len(batch):
                continue
            file, block, head = (batch.column(c) for c in ("file", "block", "head"))
            heads = head.is_valid().to_numpy(zero_copy_only=False)
            moved = np.ones(len(batch), bool)
            moved[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(
                block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            first = (file[0].as_py(), block[0].as_py())
            moved[0] = first != at
            turns = np.flatnonzero(moved | heads)
            # the header before the first turn, and that from each turn on
            found = [own, *head.take(pa.array(turns)).to_pylist()]
            own, at = found[-1], (file[-1].as_py(), block[-1].as_py())
            turn = np.zeros(len(batch), np.int64)
            turn[turns] = 1
            yield pa.RecordBatch.from_arrays(
                [file, block, batch.column("value"),
                 pa.array(found, pa.string()).take(pa.array(np.cumsum(turn)))],
                names=["file", "block", "value", "own"]).filter(pa.array(~heads))

    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    is_head = F.col("head").isNotNull()
    carried = marked.withColumn("at", F.monotonically_increasing_id()).groupBy(
        "file", "block").agg(F.max_by("head", F.when(is_head, F.col("at"))).alias("own")).select(
        "file", "block", F.last("own", ignorenulls=True).over(before).alias("carried")).where(
        "block > 0")
    rows = marked.mapInArrow(paired, "file string, block bigint, value string, own string")
    return rows.join(F.broadcast(carried), ["file", "block"], "left").select(
        "file", "value", F.coalesce("own", "carried").alias("header"))


def import_analysis_csv(
    spark: SparkSession, path: str, clip_pattern: str = CLIP_IN_PATH, file_glob: str = CSV_FILES,
    rescue: bool = False,
) -> DataFrame:
    """Analysis CSVs in bulk, columns found by name in the header above them.

    The order and number of the columns may differ from file to file, and within a file that
    holds several exports: lines are split into fields and paired with the last header before
    them.  Lines without one are read in the order of the contract.  The clip number is the
    column ``clip_id`` where there is one, else it is taken from the path, or hashed from it
    where the pattern does not match.  ``rescue`` adds a map ``rescued`` of the columns that
    the contract does not know.  The driver learns how many columns there are at most and about
    how many different headers, no more.  Lines are read, split and cast where they lie; only where
    the headers are too many to be sent to every task are lines moved to them.
    """
    lines = spark.read.option("pathGlobFilter", file_glob).option(
        "recursiveFileLookup", True).text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), "value").where("value <> ''")
    own_order = ",".join(["frame", *schema.ANALYSIS_TYPES])
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    widest, different = lines.where(F.col("value").rlike(_HEADER)).agg(
        F.max(commas), F.approx_count_distinct("value")).first()
    width = 1 + max(widest or 0, own_order.count(","))
    slots = ", ".join(f"c{i} string" for i in range(width))

    def split(text):
        fields = F.from_csv(text, slots, {"escape": '"', "maxColumns": str(width + 1)})
        return F.transform(F.array(fields), lambda f: F.array(*[f[f"c{i}"] for i in range(width)]))[0]

    # what a header says is worked out once for each different one, not for every line under it
    wanted = ["clip_id", "frame", *[c for c in schema.ANALYSIS_TYPES if c not in ("clip_id", "frame")]]
    headers = lines.where(F.col("value").rlike(_HEADER)).select(
        F.md5("value").alias("header"), F.col("value").alias("line")).unionByName(
        lines.sparkSession.range(1).select(F.lit("").alias("header"), F.lit(own_order).alias("line")))
    named = headers.distinct().select("header", split(F.col("line")).alias("names")).withColumn(
        "place", F.map_from_entries(F.filter(F.transform(
            "names", lambda name, i: F.struct(name.alias("name"), i.alias("i"))),
            lambda e: e["name"].isNotNull()))).select(
        "header", "names", F.array(*[F.col("place")[name] for name in wanted]).alias("places"))
    if (different + 1) * width <= SENT_FIELDS:
        named = F.broadcast(named)
    paired = _under_headers(lines).withColumn("header", F.coalesce("header", F.lit(""))).join(
        named, "header").select("file", "names", "places", split(F.col("value")).alias("cells"))

    def cell(name):
        return F.get("cells", F.col("places")[wanted.index(name)])

    number = F.regexp_extract("file", clip_pattern, 1)
    clip_id = F.coalesce(
        cell("clip_id").try_cast("bigint"),
        F.when(number != "", number.try_cast("bigint")).otherwise(F.xxhash64("file")))
    texts = {"landmarks_str": "{}", "barbell_box_str": ""}
    typed = [
        F.coalesce(cell(name), F.lit(texts[name])).alias(name) if name in texts
        else cell(name).try_cast(kind).alias(name)
        for name, kind in schema.ANALYSIS_TYPES.items()
    ]
    if rescue:
        known = F.array(*[F.lit(c) for c in wanted])
        typed.append(F.map_from_entries(F.filter(
            F.arrays_zip("names", "cells"),
            lambda e: e["names"].isNotNull() & ~F.array_contains(known, e["names"]))).alias(
            "rescued"))
    return paired.select(
        clip_id.alias("clip_id"), cell("frame").try_cast("bigint").alias("frame"), *typed)


def write_report(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One table of markdown texts, a row per clip."""
    reports.select("clip_id", "report").write.mode(mode).parquet(path)


def export_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A markdown text in a folder per clip, for clips that were chosen before."""
    reports.select("clip_id", "report").repartition("clip_id").write.mode(mode).partitionBy(
        "clip_id").text(path)
