"""Every operator's query over a whole table, next to the plainest way to compute it."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from liftengine.llm import queries as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def result(spark, medium):
    held = {}

    def get(name):
        if name not in held:
            held[name] = [r.asDict() for r in Q.queries()[name](spark, medium).collect()]
        return held[name]

    return get


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.vocabulary())


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_fingerprints(result, documents):
    rows = {r["doc_id"]: r for r in result("op1_fingerprints")}
    assert len(rows) == len(documents)
    by_text = {}
    for k, (doc, text) in enumerate(documents):
        after = documents[k - 1]  # descending: the first follows the last
        half = len(text) // 2
        edited = text[:len(text) - half] + after[1][:half]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if after[1] == text:
            assert row["near_next"] == 1
    near = sum(r["near_edited"] for r in rows.values()) / len(rows)
    assert near > 5 * sum(r["near_next"] for r in rows.values()) / len(rows)


def test_token_files(result, documents, whole):
    rows = {r["doc_id"]: r for r in result("op2_token_files")}
    start = 0
    for doc, text in documents:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        row = rows.pop(doc)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not rows


def test_packing(result, documents, whole):
    rows = sorted(result("op8_packing"), key=lambda r: (r["doc_id"], r["piece"]))
    wanted = []
    for doc, text in documents:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, a in enumerate(range(0, len(ids), Q.SEQUENCE)):
            part = ids[a:a + Q.SEQUENCE]
            wanted.append((doc, piece, a, len(part), crc(part)))
    assert [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
            for r in rows] == wanted
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= Q.SEQUENCE
    least = -(-sum(r["length"] for r in rows) // Q.SEQUENCE)
    assert len(by_sequence) <= least * 1.02 + 1


def test_templates(spark, medium, result):
    """These pages hold their text in one article of a heading and paragraphs."""
    rows = {r["page_id"]: r for r in result("op3_templates")}
    for page in spark.read.parquet(f"{medium}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip()
                  for b in re.split(r"</?(?:p|h1)>", inside)]
        row = rows.pop(page["page_id"])
        assert row["text"] == "\n\n".join(b for b in blocks if b)
        assert (row["url"], row["n_chars"]) == (page["url"], len(row["text"]))
    assert not rows


def test_suffixes(result, documents):
    rows = {r["doc_id"]: r for r in result("op4_suffixes")}
    seen, cut = set(), 0
    for doc, text in documents:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            string = raw[i:i + 100]
            if string in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        cut += spans
        row = rows.pop(doc)
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (
            len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert not rows and cut > 100


def test_jaccard(result, documents):
    sets = {}
    for doc, text in documents:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        width = min(3, len(w))
        sets[doc] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if w else set()
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if not small or 100 * small < 90 * large:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= 90 * (small + large - both):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result("op5_jaccard")}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    assert sum(d != c for d, (_, c) in got.items()) > 50


def test_mixing(result, documents):
    rows = result("op6_mixing")
    texts = dict(documents)
    size = {d: len(WORDS.findall(t or "")) for d, t in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by_source = defaultdict(list)
    for r in rows:
        by_source[(r["source_size"], r["target"])].append(r)
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(size.values()))
    for (total, target), own in by_source.items():
        assert sum(r["size"] for r in own) == total and target <= 2 * total + 1e-6
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        most = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= most
    assert len(texts) == len(rows)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+",
                 lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]",
                  lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (pattern, good) in kinds.items()
            for m in re.finditer(pattern, text) if good(m[0])]


def test_pii(result, documents):
    rows = {r["doc_id"]: r for r in result("op7_pii")}
    assert len(rows) == len(documents)
    seen = Counter()
    for doc, text in documents:
        spans = base_spans(text or "")
        row, said = rows[doc], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["spans"] == said or row["spans"].startswith(said + "," if said else "term:")
        counts = Counter(k for k, _, _ in spans)
        seen.update(counts)
        for kind in ("email", "ip", "card", "phone"):
            assert row[f"n_{kind}"] == counts[kind]
    assert all(seen[k] for k in ("email", "ip", "card", "phone"))


def test_pii_terms(result, documents):
    """Term spans of the whole table, equal to counting every pair of entity and term."""
    size, held = len(documents), []
    n_term, n_entity, n_pair = Counter(), Counter(), Counter()
    for doc, text in documents:
        text = text or ""
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", text)]
        n_term.update({w for w, _, _ in words})
        spans = base_spans(text)
        entities = {(k, text[a:b].lower() if k in ("email", "ip") else re.sub(r"[^0-9]", "", text[a:b]))
                    for k, a, b in spans}
        words = [w for w in words if not any(a < w[2] and w[1] < b for _, a, b in spans)]
        n_entity.update(entities)
        n_pair.update({(e, w) for e in entities for w, _, _ in words})
        held.append((doc, spans, entities, words))
    risky = {(e, t) for (e, t), n in n_pair.items() if n_entity[e] < size and math.log2(
        size * n / n_entity[e] / n_term[t]) * n / (n + 1) >= 0.5 * math.log2(size / n_entity[e]) - 1e-9}
    rows = {r["doc_id"]: r["spans"] for r in result("op7_pii")}
    terms = of = 0
    for doc, spans, entities, words in held:
        gone = [("term", a, b) for w, a, b in words if any((e, w) in risky for e in entities)]
        terms += len(gone)
        of += len(words) if entities else 0
        assert rows[doc] == ",".join(f"{k}:{a}:{b}" for k, a, b in [*spans, *gone])
    assert max(n_entity.values()) < 3 and 100 < terms < 0.25 * of


def test_sharding(result, documents):
    rows = {r["doc_id"]: r for r in result("op9_sharding")}
    home, load, slots = {}, Counter(), defaultdict(list)
    for doc, text in documents:
        raw, row = (text or "").encode(), rows.pop(doc)
        assert (row["size"], row["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert home.setdefault(text, row["shard"]) == row["shard"]
        load[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
    assert not rows and set(load) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 40


def test_quality(result, documents):
    rows = {r["doc_id"]: r for r in result("op10_quality")}
    for doc, text in documents:
        w = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i:i + 8])].append(i)
        covered = {j for places in at.values() if len(places) > 1
                   for i in places for j in range(i, i + 8)}
        row = rows[doc]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"],
                row["n_repeat_words"], row["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and row["kept"])


def test_quality_agrees_with_labels(spark, medium, result):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{medium}/labels.parquet").select(
        "doc_id", "quality").collect()}
    verdicts = [(labels[r["doc_id"]], r["kept"], r["base_failed"])
                for r in result("op10_quality") if r["doc_id"] in labels]
    good = [k for q, k, f in verdicts if q == 1 and not f]
    bad = [k for q, k, f in verdicts if q == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_twins(spark, medium, name):
    from tests.compare import compare, duck

    assert compare(spark, duck(medium), medium, Q.queries()[name], Q.oracle_sql()[name]) == ""
