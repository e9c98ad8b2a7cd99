"""Order MinHash fingerprints of texts, as column expressions only.

A text becomes its word k-mers (k = 3; a shorter text is one k-mer of all its words), each
numbered by how many equal ones stand before it.  The hash of (k-mer, number) falls into
one of ``COMPONENTS`` parts with ``PICKED`` cells each.  The smallest hash of every cell is
selected; the selected k-mers of a part are put back into text order and hashed as a tuple.
So equal sets of k-mers in another order give another fingerprint, which makes the share of
equal components follow edit distance rather than set overlap.  Cells stand in for
independent hash functions: each k-mer is hashed once and not once per component.

A component without any k-mer is 0 and counts for a likeness only where the other one has
it.  Defined cases: NULL text is the empty text; texts without words have components 0 only
and a likeness of 1 to one another, 0 to all others.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import let, text_of, total, words

K = 3
COMPONENTS = 64
PICKED = 2
#: Bits of a sort key: cell, hash, position.  2^24 words are more than 16 million.
CELL_BITS, HASH_BITS, AT_BITS = 7, 33, 24


def _kmers(found: Column) -> Column:
    """One hash per k-mer, in text order; texts of fewer words are one k-mer."""
    single = F.transform(found, lambda w: F.xxhash64(w))
    return let(single, lambda h: F.when(
        F.size(h) <= K, F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .otherwise(F.array(F.xxhash64(h))),
    ).otherwise(F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]))))


def _numbered(kmers: Column) -> Column:
    """Hashes of (k-mer, number of equal ones before), packed with the position."""
    at = (1 << AT_BITS) - 1
    ordered = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(F.lit(~at).cast("bigint")).bitwiseOR(
        i.cast("bigint"))))

    def start(s: Column, i: Column, own: Column) -> Column:
        """The first place of the run of equal k-mers, found by halving steps."""
        steps = F.array(*[F.lit(1 << b) for b in range(AT_BITS - 1, -1, -1)])
        return F.aggregate(steps, i, lambda lo, step: F.when(
            (lo >= step) & (F.shiftright(F.get(s, lo - step), AT_BITS) == own), lo - step,
        ).otherwise(lo))

    def number(s: Column, i: Column, own: Column) -> Column:
        return F.when((i == 0) | (F.shiftright(F.get(s, i - 1), AT_BITS) != own), F.lit(0)
                      ).otherwise(i - start(s, i, own))

    # cell and hash come from the hash of (k-mer, number)
    return let(ordered, lambda s: F.transform(s, lambda x, i: F.shiftleft(
        F.shiftrightunsigned(F.xxhash64(
            F.shiftright(x, AT_BITS), number(s, i, F.shiftright(x, AT_BITS))), AT_BITS), AT_BITS,
    ).bitwiseOR(x.bitwiseAND(F.lit(at).cast("bigint")))))


def fingerprint(text: Column) -> Column:
    """The components as an array of integers, in ascending part; only parts with k-mers.

    Each entry holds part and tuple hash: ``part << 32 | hash``.
    """
    cells = 64 - CELL_BITS
    packed = F.sort_array(_numbered(_kmers(words(text))))
    least = let(packed, lambda s: F.filter(s, lambda x, i: (i == 0) | (
        F.shiftright(x, cells) != F.shiftright(F.get(s, i - 1), cells))))

    def part(x: Column) -> Column:
        return F.shiftrightunsigned(x, cells + 1)

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << AT_BITS) - 1).cast("bigint"))

    def tuple_hash(x: Column, y: Column) -> Column:
        """Of one or two selected k-mers of a part, in text order."""
        low, high = F.shiftright(x, AT_BITS), F.shiftright(y, AT_BITS)
        return F.when(y.isNull() | (part(x) != part(y)), F.xxhash64(low)).when(
            position(x) < position(y), F.xxhash64(low, high)).otherwise(F.xxhash64(high, low))

    return let(least, lambda m: F.filter(F.transform(m, lambda x, i: F.when(
        (i > 0) & (part(F.get(m, i - 1)) == part(x)), F.lit(None).cast("bigint"),
    ).otherwise(F.shiftleft(part(x), 32).bitwiseOR(
        F.shiftrightunsigned(tuple_hash(x, F.get(m, i + 1)), 32)))), lambda x: x.isNotNull()))


def likeness(one: Column, two: Column) -> Column:
    """Equal components as a share of those that either text has."""
    parts = F.size(F.array_distinct(F.concat(
        F.transform(one, lambda x: F.shiftrightunsigned(x, 32)),
        F.transform(two, lambda x: F.shiftrightunsigned(x, 32)))))
    return F.when(parts == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(one, two)).cast("double") / parts)


def as_text(components: Column) -> Column:
    """All components as hexadecimal text, part after part; a missing one is zeros."""
    return let(F.map_from_entries(F.transform(components, lambda x: F.struct(
        F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))))),
        lambda m: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(COMPONENTS - 1).cast("bigint")),
            lambda p: F.lower(F.lpad(F.hex(F.coalesce(
                F.try_element_at(m, p), F.lit(0).cast("bigint"))), 8, "0"))), ""))


def _cuts(ids: DataFrame, per_range: int, most: int) -> list[int]:
    """Ids, descending, that cut the table into ranges of ``per_range`` rows or more."""
    parts = min(most, -(-ids.count() // per_range))
    if parts <= 1:
        return []
    found = ids.select(F.percentile_approx(
        "doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("q")).first()
    return sorted(set(found["q"] or []), reverse=True)


def with_next(docs: DataFrame, per_range: int = 1_000, most: int = 20_000) -> DataFrame:
    """doc_id, text and fp of every document, with next_text and next_fp.

    Next is the following row in descending doc_id (NULL last, ties by text); the first
    follows the last.  The table is cut into at most ``most`` ranges of ids, for which the
    driver holds a boundary and the largest id each.  Every range also receives the first
    row of the range after it, so that texts are exchanged once.
    """
    base = docs.select("doc_id", text_of().alias("text"))
    ids = docs.select("doc_id")
    cuts = _cuts(ids, per_range, most)
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))] or [F.lit(0)])
    # how many cuts lie above the id, by halving steps; NULL belongs to the last range
    part = F.coalesce(let(bounds, lambda b: F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
        (step > 0) & (lo + step <= len(cuts)) & (F.get(b, lo + step - 1) > F.col("doc_id")),
        lo + step).otherwise(lo))) + F.col("doc_id") * 0, F.lit(len(cuts))).cast("int")
    heads = dict(ids.groupBy(part.alias("part")).agg(F.max("doc_id")).collect())
    if not heads:
        return base.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"),
                           F.col("text").alias("next_text"),
                           F.array().cast("array<bigint>").alias("next_fp"))
    filled = sorted(heads)
    goes_to = {p: filled[i - 1] for i, p in enumerate(filled)}
    every = range(len(cuts) + 1)
    head = F.get(F.lit([heads.get(p) for p in every]).cast("array<bigint>"), F.col("part"))
    target = F.get(F.lit([goes_to.get(p, -1) for p in every]).cast("array<int>"), F.col("part"))
    real = F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost"))
    sent = base.withColumn("part", part).withColumn(
        "fp", fingerprint(F.col("text"))).select(
        "doc_id", "text", "fp", F.explode(F.when(
            F.col("doc_id").eqNullSafe(head),
            F.array(real, F.struct(target.alias("part"), F.lit(1).alias("ghost"))),
        ).otherwise(F.array(real))).alias("at"))
    order = Window.partitionBy("at.part").orderBy(
        "at.ghost", F.col("doc_id").desc_nulls_last(), "text")
    return sent.select(
        "doc_id", "text", "fp", "at", F.lead("text").over(order).alias("next_text"),
        F.lead("fp").over(order).alias("next_fp")).where("at.ghost = 0").drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint and its likeness to the next document."""
    return with_next(docs).select(
        "doc_id", "text", "fp", "next_text", "next_fp",
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of an edited form of it.

    The edit replaces the last floor(n/2) code points by the first as many of the next text.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring("next_text", F.lit(1), half))
    return fingerprints(docs).withColumn("edited", edited).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fp", "near_next",
        fingerprint(F.col("edited")).alias("edited_fp")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next")
