import pytest

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source)."""

    def build(*rows):
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def medium():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, medium):
    """Every row of the medium table, as (doc_id, text)."""
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)
