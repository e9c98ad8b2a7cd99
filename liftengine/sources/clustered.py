"""Frame tables stored by clip, so that joins and sums by clip read them without an exchange.

Tables are bucketed by clip and *part*, a stretch of ``PART_FRAMES`` frames of the clip.  A long
clip so has its rows in many buckets, and none grows with it.  Two tables with the same number
of buckets join by (clip, part, frame) where they lie; sums per clip are made per part
first and only those few rows move.

Bucketing is a property of catalog tables; the files lie where ``path`` says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"
PART_FRAMES = 32_768
BUCKETS = 64
KEY = ("clip_id", PART, "frame")


def save_clustered(
    df: DataFrame, table: str, path: str, buckets: int = BUCKETS, part_frames: int = PART_FRAMES,
    mode: str = "errorifexists",
) -> None:
    """Store ``df`` (clip_id, frame, ...) as the catalog table ``table``, a file per bucket.

    Tables that are to be joined need the same ``buckets`` and ``part_frames``.
    """
    part = F.floor(F.col("frame") / F.lit(part_frames)).cast("bigint")
    df.withColumn(PART, part).repartition(buckets, "clip_id", PART).write.mode(mode).bucketBy(
        buckets, "clip_id", PART).sortBy(*KEY).option("path", path).saveAsTable(table)


def read_clustered(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def join_clustered(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join two stored tables by frame; both lie by clip and part already."""
    return left.join(right.hint("merge"), list(KEY), how)


def sum_up_clips(df: DataFrame, *sums) -> DataFrame:
    """Sums per clip: ``sums`` are (name, column), added up in each part before anything moves."""
    parts = df.groupBy("clip_id", PART).agg(*[F.sum(c).alias(name) for name, c in sums])
    return parts.groupBy("clip_id").agg(*[F.sum(name).alias(name) for name, _ in sums])
