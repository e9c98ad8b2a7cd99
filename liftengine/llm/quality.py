"""Line-first quality rules, as column expressions only.

Every line is judged by itself, and runs of short lines without an end as a menu; failing lines
go; a document that loses too much of its text that way is rejected.  Boilerplate phrases count
by their share of the line's words, so that one mention costs no paragraph.  Two measures of
the whole document come first: too few words, and too many words in repeated eight-word windows.

Defined cases: NULL text counts as empty.  An empty text, or one of white space only, has
no words, fails the base rule and is rejected.  Blank lines are neither kept nor lost.
A line that is lost as part of a menu is lost wherever else it stands in the document.
Repeated rows are judged alike, each by itself.  Columns of the table that have the name
of a result column are not read and give way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftengine.llm.common import SPACE, SPACES, free_name, let, text_of, total, words

SYMBOLS = "#*$%&|<>"
#: Phrases of lines that belong to the page and not to its text, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookies", "enable javascript",
    "follow us on", "licensed under", "lorem ipsum", "privacy policy", "read more",
    "sign up", "subscribe to", "terms of service", "terms of use",
)
#: Words that separate entries of a menu or a breadcrumb.
SEPARATORS = ("|", ">", "»", "›", "•", "·")
#: A sentence ends somewhere in the line.
ENDED = r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)"
#: What may stand at the end of a line that is no entry of a menu.
PAUSED = r"[.!?…。！？,;:][\"'”’»)\]]*[\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_pct`` are the base rule, the rest judge lines.

    Shares are of the words of a line, ``max_lost`` is of the characters of a document.
    ``menu_lines`` lines one after another, of at most ``menu_words`` words and no punctuation
    at the end, are a menu.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbols: float = 0.3
    max_separators: float = 0.2
    max_stutter: float = 0.2
    unpunctuated_words: int = 12
    max_boilerplate: float = 0.1
    menu_words: int = 3
    menu_lines: int = 5
    max_lost: float = 0.5


def repeated_words(found: Column, width: int = 8) -> Column:
    """How many words lie in windows of eight words that occur twice or more in the text.

    Window hashes are made by doubling, three passes instead of eight words per window.
    Sorting by (hash, position) happens only in texts that repeat a window at all.
    """
    if width != 8:
        raise ValueError("windows have eight words")

    def joined(hashes: Column, by: int) -> Column:
        return let(hashes, lambda h: F.transform(
            h, lambda x, i: F.xxhash64(x, F.get(h, i + by))))

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(
            windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(ordered, lambda s: F.transform(
            F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"])
                     | (e["h"] == F.get(s, k + 1)["h"])),
            lambda e: e["i"]))
        return let(F.array_sort(at), lambda p: total(F.transform(
            p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))))

    single = F.transform(found, lambda w: F.xxhash64(w))
    windows = F.slice(joined(joined(joined(single, 1), 2), 4), F.lit(1),
                      F.greatest(F.size(found) - (width - 1), F.lit(0)))
    return F.when(F.size(found) <= width, F.lit(0).cast("bigint")).otherwise(
        let(windows, lambda w: F.when(
            F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint"),
        ).otherwise(covered(w))))


def line_passes(line: Column, limits: Limits = Limits()) -> Column:
    """Whether a line that is not blank is text: punctuation, navigation, boilerplate."""
    low = F.lower(line)
    # words of the phrases in the line, each phrase once
    boilerplate = F.lit(0)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate + F.when(low.contains(phrase), len(phrase.split())).otherwise(0)

    def judged(w: Column) -> Column:
        n = F.size(w)
        symbols = (F.length(line) - F.length(F.translate(line, SYMBOLS, ""))) / 3.0 + (
            F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2.0
        separators = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        stutter = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
        ended = line.rlike(ENDED)
        return ~(
            (symbols > limits.max_symbols * n)
            | (separators > limits.max_separators * n)
            | ((n >= 5) & (stutter > limits.max_stutter * n))
            | ((n >= limits.unpunctuated_words) & ~ended)
            | (boilerplate > limits.max_boilerplate * n))

    return let(words(line), judged)


def menu_lines(lines: Column, limits: Limits = Limits()) -> Column:
    """Those of a text's lines, none of them blank, that lie in a run of menu entries."""
    many = limits.menu_lines

    def entry(x: Column) -> Column:
        return (F.size(F.split(F.btrim(x, F.lit(SPACE)), SPACES)) <= limits.menu_words) & ~x.rlike(PAUSED)

    def runs(flags: Column) -> Column:
        """Whether ``many`` entries start at each line."""
        return F.transform(flags, lambda f, i: F.forall(
            F.sequence(F.lit(0), F.lit(many - 1)), lambda d: F.coalesce(F.get(flags, i + d), F.lit(False))))

    def held(starts: Column) -> Column:
        return F.filter(lines, lambda x, i: F.exists(
            F.sequence(F.lit(0), F.lit(many - 1)),
            lambda d: (d <= i) & F.coalesce(F.get(starts, i - d), F.lit(False))))

    none = F.array().cast("array<string>")
    return let(F.transform(lines, entry), lambda flags: F.when(
        total(F.transform(flags, lambda f: f.cast("int"))) < many, none,
    ).otherwise(let(runs(flags), held)))


def _nonblank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def measures(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of the base measures, the cleaned text and the verdict."""

    def built(t: Column, found: Column, lines: Column) -> Column:
        n_words = F.size(found).cast("bigint")
        repeats = repeated_words(found)
        once = F.array_distinct(lines)
        passed = F.filter(once, lambda x: line_passes(x, limits))
        kept = let(menu_lines(lines, limits), lambda m: F.when(
            F.size(m) == 0, passed).otherwise(F.array_except(passed, m)))

        def verdict(repeated: Column, good: Column) -> Column:
            failed = (n_words < limits.min_words) | (
                F.lit(100) * repeated > F.lit(limits.max_repeat_pct) * n_words)
            size = total(F.transform(lines, lambda x: F.length(x)))
            left = total(F.transform(good, lambda x: F.length(x)))
            return F.struct(
                n_words.alias("n_words"),
                F.length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint")
                .alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")
                .alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (left >= (1 - limits.max_lost) * size)).alias("kept"),
                (F.size(lines) - F.size(good)).cast("bigint").alias("n_lost_lines"),
                F.array_join(good, "\n").alias("clean_text"))

        return let(repeats, lambda r: let(kept, lambda g: verdict(r, g)))

    return let(text, lambda t: let(words(t), lambda w: let(
        F.filter(F.split(t, "\n"), _nonblank), lambda x: built(t, w, x))))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``clean_text`` of each row.

    A lost line is one that fails its rule or repeats an earlier line.
    """
    held = free_name(docs, "judged")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "n_lost_lines", "clean_text")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*own, measures(text_of(), limits).alias(held)).select(
        *own, *[F.col(held)[n].alias(n) for n in names])


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that stay, without their lost lines; the columns are those of ``docs``."""
    kept = judge(docs, limits).where("kept")
    return kept.select(*[
        {"text": F.when(F.col("n_lost_lines") == 0, F.col("text"))
         .otherwise(F.col("clean_text")).alias("text"),
         "n_chars": F.length(F.when(F.col("n_lost_lines") == 0, F.col("text"))
                             .otherwise(F.col("clean_text"))).cast("bigint").alias("n_chars"),
         }.get(c, F.col(f"`{c}`")) for c in docs.columns if c in kept.columns])
