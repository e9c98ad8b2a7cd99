"""Analysing the clips of a growing folder, each of them once.

A clip's row in ``clips`` is written when its other tables are complete, so new files there
announce new clips.  They are read as a stream.  Each micro-batch is a run: the clips that no
earlier run has finished are analysed, every table goes to its own folder of that run, and the
run's clips to the manifest, last of all.  Only runs in the manifest count.  A run that was
broken off is done again under the same number and writes over its own folders, so each clip's
rows are there exactly once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from liftengine import schema
from liftengine.plans.fleet import analyze
from liftengine.sources.scratch import write_scratch
from liftengine.sources.tracks import Tracks, read_tracks

MANIFEST = "clip_id bigint, run bigint"


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The clips that are done, with the run that did them."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_results(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of all finished runs, with the column ``run``."""
    runs = finished(spark, out).select("run").distinct()
    rows = spark.read.option("mergeSchema", True).parquet(f"{out}/{name}")
    return rows.withColumn("run", rows["run"].cast("bigint")).join(runs, "run", "left_semi")


def _only(tracks: Tracks, clips: DataFrame) -> Tracks:
    """The tracks of the given clips; the list of clips is small beside their frames."""
    chosen = clips.select("clip_id")

    def keep(df):
        return None if df is None else df.join(chosen, "clip_id", "left_semi")

    return replace(
        tracks, clips=clips, frames=keep(tracks.frames), landmarks=keep(tracks.landmarks),
        detections=keep(tracks.detections), flow=keep(tracks.flow))


def analyze_new(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> None:
    """Analyse the clips below ``path`` that are not finished below ``out`` yet.

    ``options`` are those of `analyze`.  A clip that is announced again is left alone.
    """
    def run(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        done = finished(own, out).where(f"run <> {number}").select("clip_id")
        fresh = write_scratch(
            batch.dropDuplicates(["clip_id"]).join(done, "clip_id", "left_anti"), "fresh")
        if fresh.isEmpty():
            return
        tables = analyze(_only(read_tracks(own, path), fresh), **options)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/run={number}")
        fresh.select("clip_id").write.mode("overwrite").parquet(f"{out}/manifest/run={number}")

    clips = spark.readStream.schema(schema.CLIPS).parquet(f"{path}/clips")
    clips.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
