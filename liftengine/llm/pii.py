"""Personal data: patterns, and terms that give a protected entity away.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern.  The
method then asks which other words reveal such an entity e.  Over all documents, with

    IC(e)    = log2(N / n(e))                       how much learning e tells
    PMI(e,t) = log2(N n(e,t) / (n(e) n(t)))         how much of it the term t tells

a term in a document of e is risky if PMI(e,t) n(e,t) / (n(e,t) + 1) >= disclosure * IC(e),
that is, if it gives away at least that share of what identifies e, after a discount for small
counts: one joint document is little evidence.  This holds for entities of any number of
documents: with e in one document only, and half of IC(e) as the limit, its terms that no other
document has are risky; with e in two, both with t, those in at most N ** 0.25 * 2 ** 0.75.  n(t) counts documents with the term anywhere, n(e,t) those of e that have it
outside the base spans.  Risky terms are removed from every document of that entity, wherever
in the text they stand, and stay in other documents: a number becomes a number mark, any
other word a term mark.

Everything is column expressions, joins and aggregates.  Counts are pre-aggregated per
task; texts are not exchanged for finding spans.

Defined cases: NULL text is the empty text, without spans.  Spans count code points, the end
is exclusive.  Kinds are searched independently, so spans of different kinds may overlap;
when texts are rewritten overlapping spans become one.  Repeated rows get equal results, and
each row counts as a document.  Columns of the table that have the name of a result column
give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftengine.llm.common import let, text_of, total
from liftengine.sources.scratch import write_scratch

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
_LOCAL = "A-Za-z0-9._%+-"
#: A match starts where a run of its first class starts, or where the last match ended.
#: Saying so, and giving nothing back (``++``), keeps long runs linear.  A card number is a
#: whole run of digits with single separators; only runs of 16 to 19 digits are looked at.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "phone": "+"}
WORD = r"[\p{L}\p{N}]{3,}+"
#: Pieces of a text that end where a word ends, so that finding words stays linear.
PIECE = r"(?s).{2048}[\p{L}\p{N}]*+|.++"
_SPANS = "array<struct<start:int,end:int,found:string>>"
_TERMS = "array<struct<term:string,start:int,end:int>>"
#: So many terms at most are sent to all tasks, to be left out as never risky.
COMMON = 10_000
#: Logarithms of equal ratios may differ by rounding.
_EQUAL = 1e-9


@dataclass(frozen=True)
class Limits:
    disclosure: float = 0.5


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places: start, end, found."""

    def placed(found: Column) -> Column:
        gaps = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(
            F.length(g).alias("gap"), m.alias("found")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

        def step(acc: Column, e: Column) -> Column:
            start = acc["at"] + e["gap"]
            return F.when(e["found"].isNull(), acc).otherwise(F.struct(
                (start + F.length(e["found"])).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(
                    start.alias("start"), (start + F.length(e["found"])).alias("end"),
                    e["found"].alias("found")))).alias("spans")))

        return F.aggregate(gaps, empty, step, lambda acc: acc["spans"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) == 0, F.array().cast(_SPANS)).otherwise(placed(m)))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(
        d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return total(doubled) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (
            F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans of a text as structs (kind, start, end, found), by kind, then start."""

    def of(kind: str, t: Column) -> Column:
        none = F.array().cast("array<struct<kind:int,start:int,end:int,found:string>>")
        hint = t.contains(HINTS[kind]) if kind in HINTS else t.rlike(
            r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9]{2}|[0-9][\x20-][0-9]")
        spans = F.transform(
            F.filter(located(t, PATTERNS[kind]), lambda s: _valid(kind, s["found"])),
            lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
                               s["end"].alias("end"), s["found"].alias("found")))
        return F.when(hint, spans).otherwise(none)

    return let(text, lambda t: F.concat(*[of(kind, t) for kind in PATTERNS]))


def _entity(span: Column) -> Column:
    """The same entity however it is written: lower case, numbers as digits."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(
        span["kind"] <= 1, F.lower(span["found"])).otherwise(_digits(span["found"])))


def _terms(text: Column, spans: Column) -> Column:
    """All words of a text outside its base spans, as (term, start, end)."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<at:int,piece:string>>").alias("pieces"))
    pieces = F.aggregate(
        F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), none, lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"), F.concat(acc["pieces"], F.array(F.struct(
                acc["at"].alias("at"), p.alias("piece")))).alias("pieces")),
        lambda acc: acc["pieces"])
    found = F.flatten(F.transform(pieces, lambda p: F.transform(
        located(p["piece"], WORD), lambda s: F.struct(
            F.lower(s["found"]).alias("term"), (p["at"] + s["start"]).alias("start"),
            (p["at"] + s["end"]).alias("end")))))
    return F.filter(found, lambda t: ~F.exists(spans, lambda s: (
        s["start"] < t["end"]) & (t["start"] < s["end"])))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans, their entities and the terms, written once."""
    based = docs.select("doc_id", F.xxhash64(text_of(), F.lit(1)).alias("digest"), let(
        text_of(), lambda t: let(base_spans(t), lambda s: F.struct(
            s.alias("spans"), F.array_distinct(F.transform(s, _entity)).alias("entities"),
            F.when(F.size(s) == 0, F.array().cast(_TERMS)).otherwise(_terms(t, s)).alias("terms")
        ))).alias("b"))
    return write_scratch(based.select("doc_id", "digest", "b.spans", "b.entities", "b.terms"), "pii")


def _near(base: DataFrame, never: DataFrame) -> DataFrame:
    """doc_id, digest, entity and term, start, end of all terms but those in ``never``."""
    each = base.where(F.size("entities") > 0).select(
        "doc_id", "digest", F.explode("entities").alias("entity"), "terms")
    return each.select("doc_id", "digest", "entity", F.explode("terms").alias("x")).select(
        "doc_id", "digest", "entity", "x.*").join(F.broadcast(never), "term", "left_anti")


def _counts(docs: DataFrame, base: DataFrame, limits: Limits):
    """The number of rows, n(e), n(t), and the commonest of the terms that are never risky.

    As n(e,t) <= n(e), no entity makes a term risky that is in more than N (n/N) ** disclosure
    documents, n being the largest n(e).  Leaving those out changes no result.
    """
    entities = write_scratch(base.where(F.size("entities") > 0).select(
        F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count("*").alias("n_entity")), "pii-entities")
    terms = write_scratch(docs.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)), F.lower))).alias("term")).groupBy(
        "term").agg(F.count("*").alias("n_term")), "pii-terms")
    size = base.count()
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    bound = size * (most / max(size, 1)) ** limits.disclosure * (1 + 1e-6)
    never = terms.where(F.col("n_term") > bound).orderBy(F.desc("n_term"), "term").limit(
        COMMON).select("term")
    return size, entities, terms, never


def term_spans(docs: DataFrame, base: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document with risky terms: doc_id, digest and the distinct spans of the terms."""
    rows, entities, terms, never = _counts(docs, base, limits)
    distinct = base.withColumn("terms", F.transform(F.array_distinct(F.transform(
        "terms", lambda x: x["term"])), lambda t: F.struct(t.alias("term"))))
    pairs = _near(distinct, never).groupBy("entity", "term").agg(F.count("*").alias("n_pair"))
    size = F.lit(float(rows))
    pmi = F.log2(size * F.col("n_pair") / F.col("n_entity") / F.col("n_term")) * (
        F.col("n_pair") / (F.col("n_pair") + 1))
    content = F.log2(size / F.col("n_entity"))
    risky = pairs.join(entities, "entity").join(terms, "term").where(
        (content > 0) & (pmi >= limits.disclosure * content - _EQUAL)).select("entity", "term")
    hit = _near(base.where(F.size("entities") > 0).dropDuplicates(
        ["doc_id", "digest"]), never).join(risky, ["entity", "term"])
    return hit.groupBy("doc_id", "digest").agg(F.collect_set(F.struct(
        F.lit(TERM).alias("kind"), "start", "end", F.col("term").alias("found"))).alias("terms"))


def spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and digest of every document with ``base`` and ``terms``, arrays of spans."""
    base = found(docs)
    extra = term_spans(docs, base, limits).select(
        F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.array_sort("terms").alias("t"))
    return base.join(extra, F.col("doc_id").eqNullSafe(F.col("id"))
                     & (F.col("digest") == F.col("d")), "left").select(
        "doc_id", "digest", F.col("spans").alias("base"), F.coalesce("t", F.array().cast(
            "array<struct<kind:int,start:int,end:int,found:string>>")).alias("terms"))


def as_text(found_spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(text: Column, all_spans: Column) -> Column:
    """The text with a mark for each span; overlapping spans get the mark of the first."""
    marks = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def mark(s: Column) -> Column:
        return F.when((s["kind"] == TERM) & s["found"].rlike("^[0-9]+$"), F.lit("[number]")
                      ).otherwise(F.get(marks, s["kind"]))

    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        ).otherwise(F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"]
        ).alias("out")))

    return F.when(F.size(all_spans) == 0, text).otherwise(let(
        F.aggregate(ordered, start, step), lambda end: F.concat(
            end["out"], F.substring(text, end["at"] + 1, F.length(text)))))


def sanitize(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with marks in place of personal data and of the terms that give it away."""
    base = found(docs)
    extra = term_spans(docs, base, limits)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"),
                       F.xxhash64(text_of(), F.lit(1)).alias("digest"))
    joined = held.join(extra.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "terms"),
                       F.col("held.doc_id").eqNullSafe(F.col("id"))
                       & (F.col("digest") == F.col("d")), "left")
    all_spans = let(F.coalesce(F.col("held.text"), F.lit("")), lambda t: F.concat(
        base_spans(t), F.coalesce(F.col("terms"), F.array().cast(
            "array<struct<kind:int,start:int,end:int,found:string>>"))))
    text = let(F.coalesce(F.col("held.text"), F.lit("")), lambda t: let(
        all_spans, lambda s: _rewritten(t, s)))
    new = joined.select("held", F.when(F.col("held.text").isNotNull(), text).alias("new"))
    return new.select(*[
        F.col("new").alias(c) if c == "text" else F.length("new").cast("bigint").alias(c)
        if c == "n_chars" else F.col("held")[c].alias(c) for c in docs.columns])
