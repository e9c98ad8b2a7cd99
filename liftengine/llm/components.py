"""Connected components of a table of links, by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at the smallest
neighbour, until all links are stars around the smallest node of their component.  The
smallest neighbour of each node is a pre-aggregated minimum that is written out and joined
back, so a node with very many links is no single task's work: Spark can split such a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.sources.scratch import write_scratch


def _pointed(links: DataFrame, up: bool) -> DataFrame:
    """One star operation on (u, v) with u > v."""
    both = links.select("u", "v")
    if up:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = write_scratch(both.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if up:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return write_scratch(moved.where(F.col("u") != F.col("v")).distinct(), "links")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(u, v) of every linked node u and the smallest node v of its component, u > v.

    ``links`` has two columns of ids in any direction; repeated links and links of a node
    to itself do no harm.
    """
    a, b = (F.col(c) for c in links.columns)
    held = write_scratch(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col("u") != F.col("v")).distinct(), "links")
    mark = _mark(held)
    while mark[0]:
        held = _pointed(_pointed(held, up=True), up=False)
        before, mark = mark, _mark(held)
        if mark == before:
            break
    return held
