"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from liftengine.llm import (
    components, fingerprints, jaccard, mixing, packing, pii, quality, sharding, suffixes,
    templates, token_files,
)
from liftengine.llm.queries import vocabulary
from liftengine.sources.scratch import scratch_path

PROSE = ("The quick brown fox jumps over the lazy dog near the river bank. It was a fine day and "
         "nobody minded the noise at all. Then the rain came, and everyone went home again. ")


def varied(n, seed=0):
    """n words of prose without repeats."""
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) + "." * (i % 9 == 8)
                    for i in range(n)) + "."


#: Rows that every operator must take: nulls, blanks, repeats, long and odd texts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, PROSE),
    (7, PROSE), (None, PROSE), (None, None), (8, "x" * 30_000), (9, varied(3_000)),
    (10, "é中\U0001f600 mixed <|endoftext|> text's"), (11, "a b c d e f g h " * 400),
]


@pytest.fixture(scope="module")
def odd(make):
    return make(*ODD)


@pytest.fixture(scope="module")
def clashing(odd):
    """The same rows with columns named like results and helpers."""
    names = ("size", "target", "copies", "kept", "base_failed", "part", "key", "digest", "spans",
             "taken", "n_words", "rep", "h", "shard", "length", "fp", "held", "row", "bin")
    return odd.select("*", *[F.lit(f"old {n}").alias(n) for n in names])


@pytest.fixture(scope="module")
def none(make):
    return make()


def run_all(docs, spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, vocabulary(), 2)
    return {
        "fingerprints": fingerprints.with_edits(docs),
        "tokens": token_files.read_tokens(spark, path),
        "suffixes": suffixes.remove_repeats(docs),
        "jaccard": jaccard.groups(docs, 3, 90),
        "mixing": mixing.mix(docs),
        "pii": pii.spans(docs),
        "sanitize": pii.sanitize(docs),
        "packing": packing.pack(docs, 64, vocabulary(), 1),
        "sharding": sharding.shard(docs, 3),
        "quality": quality.judge(docs),
    }


def test_empty_tables(none, spark):
    for name, result in run_all(none, spark).items():
        assert result.count() == 0, name
    assert mixing.sample(none).count() == jaccard.one_of_each(none).count() == 0
    assert quality.clean(none).count() == 0


def test_every_row_is_answered(odd, clashing, spark):
    for docs in (odd, clashing):
        for name, result in run_all(docs, spark).items():
            rows = result.count()
            assert rows >= len(ODD) if name == "packing" else rows == len(ODD), name


def test_stages_keep_the_columns(clashing, none, spark):
    for docs in (clashing, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name


def test_fingerprints_follow_order(make):
    forth = varied(300)
    back = " ".join(reversed(forth.split()))
    moved = " ".join(forth.split()[150:] + forth.split()[:150])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(make(
        (4, forth), (3, forth), (2, moved), (1, back))).collect()}
    assert got[4]["near_next"] == 1
    assert got[3]["near_next"] < 0.9  # nearly the same k-mers in another order
    assert got[2]["near_next"] < 0.05


def test_fingerprints_number_repeated_kmers(make):
    rows = fingerprints.fingerprints(make((2, "a b c " * 40), (1, "a b c " * 20))).collect()
    assert 0 < rows[0]["near_next"] < 1


def test_likeness_of_wordless_texts(make):
    rows = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(
        make((3, ""), (2, " "), (1, PROSE))).collect()}
    assert rows == {3: 1.0, 2: 0.0, 1: 0.0}


def test_next_over_many_ranges(make):
    ids = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]
    docs = make(*[(i, f"text {i}") for i in ids], (None, "none"))
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs, per_range=3).collect()}
    order = [*reversed(ids), None]
    texts = {**{i: f"text {i}" for i in ids}, None: "none"}
    assert got == {a: texts[b] for a, b in zip(order, [*order[1:], order[0]])}


def test_token_files_hold_special_and_missing_ids(odd, spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(odd, path, vocabulary(), 2)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, *range(6, 12)]
    starts = list(itertools.accumulate((r["n_tokens"] for r in rows), initial=0))
    assert [r["start"] for r in rows] == starts[:-1]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    ids = [*whole.encode(ODD[12][1], add_special_tokens=False).ids, 2]
    crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert [r["ids_crc32"] for r in rows if r["doc_id"] == 10] == [crc]


def removed(docs):
    return {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(docs).collect()}


def test_suffixes_overlaps_and_edges(make):
    a, b = varied(60, 1), varied(60, 2)
    assert removed(make((1, a), (2, a), (3, "- " + a + b), (4, b[:99]), (5, b[:100]))) == {
        1: (0, 0), 2: (len(a), 1), 3: (len(a), 1), 4: (0, 0), 5: (100, 1)}
    # a run overlaps itself: everything but its first occurrence goes
    assert removed(make((1, "z" * 250))) == {1: (249, 1)}


def test_suffixes_repeated_and_missing_ids(make):
    a = varied(60, 1)
    rows = suffixes.remove_repeats(make((1, a), (1, a), (None, a))).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in rows) == [
        (False, 0), (False, len(a)), (True, len(a))]


def test_difference_cover():
    found = {(x - y) % suffixes.CYCLE for x in suffixes.COVER for y in suffixes.COVER}
    assert found == set(range(suffixes.CYCLE))


def test_blocks_of_one_bucket_at_a_time(make, monkeypatch):
    """Small blocks, chunks that cut segments, and buckets with many surroundings."""
    shared = varied(40, 3)
    docs = [(i, varied(20, 100 + i) + shared[i % 7:] + varied(20, 200 + i)) for i in range(60)]
    seen, want = set(), {}
    for doc, text in docs:
        gone = bytearray(len(text))
        for i in range(len(text) - 99):
            if text[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(text[i:i + 100])
        want[doc] = sum(gone)
    monkeypatch.setattr(suffixes, "BLOCK_SEGMENTS", 5)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert {d: n for d, (n, _) in removed(make(*docs)).items()} == want
    assert sum(want.values()) > 50 * 200


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_all_pairs(make, monkeypatch, n, percent):
    """Near copies around the threshold, also when clusters are cut into small tiles."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    rng = np.random.default_rng(5)
    docs = []
    for base in range(12):
        words = varied(int(rng.integers(8, 260)), base).split()
        for _ in range(9):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 20))):
                copy[at] = f"w{rng.integers(1_000)}"
            docs.append((len(docs), " ".join(copy[: len(copy) - int(rng.integers(0, 4))])))
    sets = {}
    for doc, text in docs:
        w = text.split()
        sets[doc] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(make(*docs), n, percent).collect()}
    assert got == {d: root(d) for d in sets}
    assert 12 < len(set(got.values())) < len(docs) - 20


def test_jaccard_case_and_wordless(make):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(
        make((1, "A B C D"), (2, "a b c d"), (3, ""), (4, None), (5, "Ä b"), (6, "ä b")),
        3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_one_of_each(make):
    docs = make((4, PROSE), (2, PROSE), (3, "other"), (3, "other"), (None, "other"))
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(docs).collect()) == ["2", "3", "None"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(links).collect()) == [
        *[(i, 1) for i in range(2, 61)], (101, 100)]


def test_mixing_targets_by_resharing(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 500)],
                                  "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    want, total = {}, 1.5 * 1610
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    caps = {"a": 20, "b": 200, "c": 2000, None: 1000}
    open_ = set(weights)
    while open_:
        level = total / sum(weights[s] for s in open_)
        over = {s for s in open_ if caps[s] <= level * weights[s]}
        for s in over or open_:
            want[s] = caps[s] if over else level * weights[s]
            total -= want[s]
        open_ -= over or open_
    assert got == pytest.approx(want)


def test_mixing_agrees_with_itself(odd):
    one = sorted(map(str, mixing.mix(odd).drop("copies").collect()))
    assert one == sorted(map(str, mixing.mix(odd.repartition(5)).drop("copies").collect()))


def test_sample_repeats_whole_documents(make):
    docs = make(*[(i, varied(20, i), "ab"[i % 2]) for i in range(40)])
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    rows = mixing.sample(docs).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in rows} == {d: c for d, c in taken.items() if c}


def test_pii_edges(make):
    text = "a.b@c-d.e_f@g.h 1.2.3.400 1.22.3.4.5 +1 (068) 555-2748. 4111-1111-1111-1111 41111111"
    spans = pii.spans(make((1, text))).select(pii.as_text(F.col("base")).alias("s")).first()["s"]
    assert spans == "email:0:9,email:9:15,ip:26:34,card:56:84" or spans.startswith(
        "email:0:9,email:9:15,ip:26:34")


def test_pii_long_runs_are_linear(make):
    docs = make((1, "a" * 200_000), (2, "1" * 200_000), (3, "1." * 50_000), (4, "+1" + " 2" * 50_000),
                (5, "@" * 100_000))
    assert pii.spans(docs).count() == 5


def test_pii_terms_that_give_an_entity_away(make):
    docs = [(i, f"Please ask our Zanzibar office or write to boss@corp.example about item {i}. "
             + varied(30, i)) for i in range(5)]
    docs += [(i, "Please ask our office about something or write to anyone. " + varied(30, i))
             for i in range(5, 60)]
    found = {r["doc_id"]: [t["found"] for t in r["terms"]] for r in pii.spans(make(*docs)).collect()}
    assert "zanzibar" in found[0] and "please" not in found[0] and not found[7]
    text = pii.sanitize(make(*docs)).where("doc_id = 0").first()["text"]
    assert "[email]" in text and "[term]" in text and "Zanzibar" not in text and "corp" not in text


def test_pii_terms_far_from_an_entity_of_one_document(make):
    far = "Write to boss@corp.example soon. " + "and then " * 700 + "Zanzibar"
    docs = [(0, far), *[(i, "Please write and then write soon again") for i in range(1, 40)]]
    rows = pii.spans(make(*docs)).orderBy("doc_id").collect()
    assert [(t["found"], t["start"], t["end"]) for t in rows[0]["terms"]] == [
        ("zanzibar", len(far) - 8, len(far))]
    assert not any(r["terms"] for r in rows[1:])


def test_pii_terms_in_long_texts(make):
    word = "wörd\U0001f600 "
    text = "a@b.cd " + word * 100_000 + "İstanbul"
    found = pii.spans(make((1, text), *[(i, "wörd") for i in range(2, 9)])).where(
        "doc_id = 1").first()["terms"]
    assert [(t["start"], t["end"]) for t in found] == [(len(text) - 8, len(text))]


def test_packing_plan_is_gapless_and_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 4000), rng.integers(1, 60, 500), rng.integers(1500, 2600, 900),
                    np.full(1000, 1366), np.full(7, 4096), np.ones(5000, int)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        made = packing.plan(histogram, 4096)
        used = {}
        places = 0
        for length, rank, bins, per, first, offset in made.entries:
            for b in range(bins):
                used.setdefault(first + b, []).extend((offset + j * length, length) for j in range(per))
                places += per
        assert places == len(lengths) and len(used) == made.sequences
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
        if lengths.mean() < 1000:
            assert made.sequences <= -(-int(lengths.sum()) // 4096) * 1.01 + 1


def test_differencing_is_tighter_than_greedy():
    rng = np.random.default_rng(2)
    sizes = rng.integers(100, 20_000, 2_000)
    partials = np.zeros((2_000, 8), np.int64)
    partials[:, 0] = sizes
    places, sums = sharding.difference(partials)
    load = np.bincount(places[:, 0], sizes, 8)
    assert sorted(load) == sorted(sums)
    greedy = np.zeros(8)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(load) <= np.ptp(greedy)


def page(body, head=""):
    return f"<html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_templates_of_a_host(spark):
    """A template without article elements: the slot with most text is found over all pages."""
    rows = []
    for i in range(12):
        rows.append((i, f"http://h.example/{i}", page(
            '<div class="top"><a href="/">Home</a> <a href="/b">About us</a></div>'
            f'<div class="text"><h2>Title {i}</h2><p>{varied(40, i)}</p><p>Same line here.</p></div>'
            f'<div class="low">Made by us, {i}</div><div id="comments"><p>{varied(90, 50 + i)}</p></div>')))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.extract(pages).collect()}
    assert got[3] == f"Title 3\n\n{varied(40, 3)}"  # the line on every page is template


def test_templates_odd_pages(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("host", T.StringType())])
    pages = spark.createDataFrame([
        (1, None, None, "x"), (2, "odd", "", "x"), (3, "http://a/", "plain &amp; text", "x"),
        (4, "http://b/", "<article><p>One<p>Two &eacute;<br>three<script>no</script></article><footer>f", "x"),
        (4, "http://b/", "<article><p>One<p>Two &eacute;<br>three<script>no</script></article><footer>f", "x"),
        (5, "http://c/", '<main><header><h1>T</h1></header><aside>x</aside><p title="a>b">y  z</p></main', "x"),
        (6, "http://d/", "<p>" + "<b>" * 20_000 + "deep" + "<div>" * 300 + "er</p>", "x"),
        (7, "http://e/", '<a "' * 20_000, "x")], schema)
    got = [(r["page_id"], r["text"]) for r in templates.extract(pages).collect()]
    by_id = dict(got)
    assert len(got) == 8 and by_id[1] == by_id[2] == ""
    assert by_id[3] == "plain & text" and by_id[4] == "One\n\nTwo é three"
    assert by_id[5].startswith("T\n\ny z")
    assert templates.extract(pages.limit(0)).count() == 0


def test_quality_lines(make):
    good = "\n".join(f"{varied(12, i)}" for i in range(6))
    rows = {r["doc_id"]: r for r in quality.judge(make(
        (1, good), (2, good + "\nHome | News | Sport | About\nAll rights reserved by us."),
        (3, "\n".join(["Home | News | Sport | About | More | Less"] * 9 + ["A sentence of five words."])),
        (4, good + "\n" + good), (5, " \n \n"))).collect()}
    assert rows[1]["kept"] and rows[1]["clean_text"] == good and rows[1]["n_lost_lines"] == 0
    assert rows[2]["kept"] and rows[2]["clean_text"] == good and rows[2]["n_lost_lines"] == 2
    assert not rows[3]["kept"] and not rows[5]["kept"]
    assert rows[4]["n_dup_lines"] == 6 and rows[4]["base_failed"]


def test_quality_weighs_phrases_and_menus(make):
    """One mention costs no paragraph; runs of short bare lines go, single ones stay."""
    long = " ".join(varied(12, i) for i in range(40)) + " We have no cookies here."
    good = "\n".join(f"{varied(12, i)}" for i in range(6))
    menu = "\n".join(f"Entry {i}" for i in range(10))
    rows = {r["doc_id"]: r for r in quality.judge(make(
        (1, long), (2, "\n".join(f"word{i}" for i in range(22))), (3, f"{menu}\n{good}"),
        (4, f"A title\n{good}\nMilk\nEggs\n \nFlour, fine\nSalt"), (5, f"{good}\nEntry 3\n{menu}"),
        (6, f"{good}\nWe use cookies to help you.\nOne,\ntwo,\nthree,\nfour,\nfive."),
    )).collect()}
    assert rows[1]["kept"] and rows[1]["clean_text"] == long
    assert not rows[2]["kept"] and rows[2]["n_lost_lines"] == 22
    assert rows[3]["kept"] and rows[3]["clean_text"] == good and rows[3]["n_lost_lines"] == 10
    assert rows[4]["kept"] and rows[4]["n_lost_lines"] == 0
    assert rows[5]["clean_text"] == good and rows[5]["n_lost_lines"] == 11
    assert rows[6]["clean_text"].endswith("\nOne,\ntwo,\nthree,\nfour,\nfive.")
    assert rows[6]["n_lost_lines"] == 1


def test_pipeline_small(spark, medium):
    """What each stage must leave behind, on the whole medium table."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    clean = corpus_pipeline.quality_rules(spark, docs, medium)
    assert clean.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
    single = corpus_pipeline.near_duplicates(spark, clean, medium).cache()
    groups = jaccard.groups(clean).select("component_id").distinct().count()
    assert single.count() == groups
    safe = corpus_pipeline.personal_data(spark, single, medium)
    assert pii.spans(safe).where(F.size("base") > 0).isEmpty()
    packed = corpus_pipeline.run(spark, medium)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(
        F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n <> end or end > 4096").isEmpty()


def test_suffixes_work_in_small_pieces():
    """A worker's share of an executor's memory does not follow the batch."""
    import tracemalloc

    words = np.random.default_rng(1).integers(97, 123, 6 << 20, np.uint8).tobytes().decode()
    texts = [words[i:i + 4096] for i in range(0, len(words), 4096)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    try:
        assert sum(len(found) for found in suffixes._find([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    whole = pa.RecordBatch.from_arrays(
        [batch.column("key"), batch.column("text"), pa.nulls(len(texts), pa.list_(pa.struct(
            [("lo", pa.int32()), ("hi", pa.int32())])))], names=["doc_id", "text", "spans"])
    parts = [len(part) for part in suffixes._removed([whole])]
    assert len(parts) > 1 and sum(parts) == len(texts)


def test_jaccard_common_phrase_makes_no_candidates(make, spark):
    """Different texts with a few phrases in common are not candidates; near copies are."""
    phrase = varied(12, 999)
    docs = [(i, f"{varied(200, i)} {phrase} {varied(200, 500 + i)}") for i in range(60)]
    docs.append((60, docs[0][1] + " end"))
    held = jaccard._summary(make(*docs), 5, 80)
    pairs = {(r["u"], r["v"]) for r in jaccard._candidates(held).collect()}
    assert (60, 0) in pairs
    assert len(pairs) < 6


def test_jaccard_names_find_every_link():
    """The smaller of two sets asks by a name that the larger has, at sizes around the bands."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for size in range(4, 700, 7):
            grams = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            allowed = jaccard._allowed(len(grams), percent)
            for lost in {0, allowed // 2, allowed}:
                fresh = rng.integers(1, 1 << 62, allowed - lost).astype(np.uint64)
                other = np.unique(np.concatenate([rng.permutation(grams)[lost:], fresh]))
                common = len(np.intersect1d(grams, other))
                if 100 * common < percent * (len(grams) + len(other) - common) or not allowed:
                    continue
                one, two = (jaccard.names(s, percent) for s in (grams, other))
                met = {int(n) >> 1 for n in one} & {int(n) >> 1 for n in two}
                asked = {int(n) >> 1 for n in np.concatenate([one, two]) if int(n) & 1}
                if len(grams) != len(other) or lost:
                    assert met & asked, (percent, size, lost)
