"""Counts that a job gathers in passing, without a pass of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = "source string, metric string, value bigint"


class Counts:
    """Named counts over tables that are being read for something else.

    ``watch`` marks a table; the counts are those of the first job that reads it whole.  Ask
    for them with ``table`` after that job.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}
        self._known: list[tuple[str, str, int]] = []

    def watch(self, df: DataFrame, source: str, **metrics) -> DataFrame:
        """``df`` with its rows counted, and for each metric the rows where it holds."""
        seen = self._seen[source] = Observation(f"{source}-{id(self)}")
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
            F.count_if(condition).alias(name) for name, condition in metrics.items()])

    def watch_source(self, df: DataFrame, source: str) -> DataFrame:
        """A table as it is stored: its rows, and those with NaN, which reading makes NULL."""
        tests = [F.isnan(f.name) for f in df.schema.fields
                 if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        nan = reduce(lambda a, b: a | b, tests, F.lit(False))
        return self.watch(df, source, rows_with_nan=nan)

    def add(self, source: str, metric: str, value: int) -> None:
        self._known.append((source, metric, value))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per source and metric."""
        rows = [(source, metric, value) for source, seen in self._seen.items()
                for metric, value in seen.get.items()]
        return spark.createDataFrame(rows + self._known, COUNTS)
