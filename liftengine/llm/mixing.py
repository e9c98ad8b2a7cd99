"""Mixing sources to target weights by Pareto order sampling, as DataFrame operations only.

Sources share a total by weight; none may exceed a multiple of its own size, and what it
cannot take goes to the others.  A source with target T and size S takes floor(T/S) certain
copies of every document.  For the rest each document has the inclusion probability
p = T/S - floor(T/S) of its source and the rank

    (u / (1 - u)) / (p / (1 - p)),    u uniform, from a hash of seed and document,

and the documents with the smallest ranks are taken until the source's words are there.
Probabilities differ between sources, so this is one unequal-probability sample of fixed
size per source.

Ranks are never sorted per source.  They are cut into 256 x 256 bins; sums over bins find
the bin in which the target is reached, and only the rows of that bin are sorted.

Defined cases: NULL text has size 0; a document of size 0 takes nothing.  NULL is a source
of its own and comes last.  Repeated rows count as often as they occur; rows with equal
(doc_id, text) have equal ranks and are taken in any order, which gives equal rows.  An
empty table gives an empty mix.  Columns of the table that have the name of a result column
give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import text_of, words
from liftengine.sources.scratch import write_scratch

BINS = 256


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size) with the target of each; one row per source.

    Sources that reach ``most`` times their size are those with the smallest ratio of that
    cap to their weight.  So they are found by one running sum in that order.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(
        listed, (F.row_number().over(by_code) - 1) % len(weights)))
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = weighed.select(
        "*", cap.alias("cap"),
        (F.sum("source_size").over(everything) * F.lit(float(share))
         - F.coalesce(F.sum(cap).over(before), F.lit(0.0))).alias("left_total"),
        (F.sum("weight").over(everything)
         - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"))
    # the level that this source and all later ones would share; it is reached by the
    # first source whose cap lies above it
    level = levelled.withColumn("level", F.col("left_total") / F.col("left_weight")).withColumn(
        "open", F.col("cap") / F.col("weight") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))
                  ).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("water", final["level"]).select(
        "source", "source_size",
        F.when(F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def _rank(p: Column) -> Column:
    """The Pareto rank as rank/(1+rank), which keeps the order and lies in 0..1."""
    u = (F.shiftrightunsigned("hashed", 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))


def _plan(sized: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row per source: its target, and the bin and place in which the target is reached.

    ``sized`` has source, size and hashed.  The plan is written down, so that its size is
    known where it is joined to the rows, which then stay where they are.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = write_scratch(targets(per_source, weights, share, most).withColumn(
        "ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(F.lit(0.0))).withColumn("certain", F.floor("ratio")).withColumn(
        "p", F.col("ratio") - F.col("certain")), "aims")
    fine = _binned(sized, aims).groupBy("source", "high", "bin").agg(
        F.sum("size").alias("words"),
        F.max(F.col("p") * F.col("source_size")).alias("wanted"))
    coarse = fine.groupBy("source", "high").agg(
        F.sum("words").alias("words"), F.max("wanted").alias("wanted"))
    # the bin in which the target is reached: first of 256, then of the 256 within it
    crossing = _crossing(coarse, "high").select(
        F.col("source").alias("s"), F.col("high").alias("h"), F.col("before").alias("outside"))
    inner = fine.join(crossing, F.col("source").eqNullSafe(F.col("s"))
                      & (F.col("high") == F.col("h"))).drop("s", "h")
    cut = _crossing(inner, "bin", F.col("outside")).select(
        F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"),
        F.col("before").alias("cut_before"))
    return write_scratch(aims.join(
        cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "cuts")


def _binned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, hashed, ...) with their source's plan and the bin of their rank."""
    named = plan.withColumnRenamed("source", "plan_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("plan_source"))).drop(
        "plan_source").withColumn("rank_at", _rank(F.col("p"))).withColumn(
        "bin", F.least(F.floor(F.col("rank_at") * (BINS * BINS)), F.lit(BINS * BINS - 1))
    ).withColumn("high", F.floor(F.col("bin") / BINS))


def _taken(rows: DataFrame, plan: DataFrame, results: list[str], size: Column) -> DataFrame:
    """``results`` of each row with its ``copies``; ``size`` is worked out only where needed."""
    placed = _binned(rows, plan)
    sums = Window.partitionBy("source").orderBy("rank_at", "hashed", "words_at_edge").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.col("cut_before") + F.coalesce(F.sum("words_at_edge").over(sums), F.lit(0))
    # the document that crosses the target is taken if that comes nearer to it
    edge = placed.where(F.col("bin") == F.col("cut_bin")).withColumn(
        "words_at_edge", size).select(*results, "certain", (
            before + F.col("words_at_edge") / 2.0 <= F.col("p") * F.col("source_size"))
        .cast("int").alias("extra"))
    others = placed.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).select(
        *results, "certain", F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False))
        .cast("int").alias("extra"))
    return others.unionByName(edge).select(
        *results, (F.col("certain") + F.col("extra")).cast("int").alias("copies"))


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text_of()).alias("hashed")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0,
        seed: int = 7, columns=("doc_id",)) -> DataFrame:
    """Each row with size, source_size, target, copies and taken.

    ``columns`` are those of ``docs`` to carry along; they go to a scratch table with sizes
    and hashes, so that texts are read once.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    own = [c for c in columns if c.lower() not in made]
    # what is carried goes in one struct, so that no name of it can clash
    sized = write_scratch(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("source"),
        F.size(words(text_of())).cast("bigint").alias("size"), _hashed(seed)), "mix")
    plan = _plan(sized.select("source", "size", "hashed"), weights, share, most)
    return _taken(sized, plan, ["row", "size", "source_size", "target"], F.col("size")).select(
        *[F.col("row")[c].alias(c) for c in own], "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def _crossing(bins: DataFrame, key: str, start: Column | None = None) -> DataFrame:
    """Of each source the bin in which the running sum of words reaches what is wanted."""
    over = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = bins.withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0)) + (
        start if start is not None else F.lit(0)))
    return summed.where(
        (F.col("before") < F.col("wanted"))
        & (F.col("before") + F.col("words") >= F.col("wanted")))


def sample(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0,
           seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Only sizes and hashes are sent anywhere for the decision.  Texts stay where they are read,
    but for the few in the bins in which targets are reached.
    """
    narrow = write_scratch(docs.select(
        "source", F.size(words(text_of())).cast("bigint").alias("size"), _hashed(seed)), "mix")
    plan = _plan(narrow, weights, share, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"),
                       "source", _hashed(seed))
    held_text = F.coalesce(F.col("held")["text"], F.lit(""))
    taken = _taken(rows, plan, ["held"], F.size(words(held_text)).cast("bigint"))
    repeats = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(
        F.array().cast("array<int>"))
    return taken.select("held", F.explode(repeats).alias("copy")).select("held.*")
