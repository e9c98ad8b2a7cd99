"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process (``local[n]``) gets a temporary
    folder; on a cluster that would lie on one machine's disk, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(
                "spark.checkpoint.dir is unset: name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that nothing else uses."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet and read it back: later steps start from the files.

    Without dictionaries: measured numbers hardly repeat, and looking them up took a quarter
    of the time of the steps that read them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.enable.dictionary", False).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
