"""Main texts of web pages, with each host's template deduced from its own pages.

1. Tokens.  A page becomes tokens: an element, named by its tag and class and by the elements
   around it, or a block of text in its element.  For each host and token the counts per page
   form its occurrence vector, of which two sums of random numbers, a number per page times the
   count, are kept.  These sums are formed per task before anything is exchanged, so a host
   with very many pages is no single task's work.
2. Classes.  Tokens of a host that occur on at least half of its pages and have equal vectors
   are an equivalence class.  An element counts as one token here, so an element whose vector
   is its own is no class: it is markup of the content (the paragraphs of an article), not of
   the template; the page itself always is.  Classes nest by the elements around their tokens
   and form the template.  A text of the class of an element around it is fixed text, which
   tells nothing of the page.  What reaches this step per host is bounded by the size of two pages, whatever the number
   of pages.
3. Slots.  An element of a class that stands once on each of its pages bounds a slot.  The main
   slot is the innermost that holds at least ``MOST`` of the host's text that is neither fixed
   nor linked nor noise; among such slots that of an article or main element comes first.  A
   first-level heading of the same class as the slot belongs to it.  On hosts where all text is
   fixed (copies of one page) all text counts.
4. Extraction.  All blocks of the main slot, apart from fixed texts (all stay where they are half
   of the slot or more, as on hosts of near copies) and noise: elements that by tag, role, or a
   class or id made of listed words alone are menus, forms, notices, adverts and the like.
   Headings are never noise by their class or id, nor is an element with most of the page's text
   and its first-level heading.  A page without its host's slot, or of a host with one page,
   is its own template: vectors are then counts on this page, and no text is fixed.

Defined cases: NULL html is the empty page, with an empty text.  NULL or odd urls share one
host.  Repeated rows are separate pages.  An empty table gives no rows.  Other columns are
not read.  A page whose main slot is empty has an empty text.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The main slot has at least this share of the text that can decide.
MOST = 0.6
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|svg|template)\b[^>]*+>.*?"
    r"(?:</\1\s*>|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements that do not end a block of text.
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark
    meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    """.split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_TEXT = set("""nav footer aside form menu dialog button select option datalist head object canvas
    audio video map""".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu".split())
WORDS = set("""ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter
    notice notices pagination popup promo promoted recommended related share sharing sidebar signup
    social sponsor sponsored subscribe toolbar widget""".split())
#: Parts of a class or id that say nothing of what an element is; numbers are such parts too.
NEUTRAL = set("""area bar block bottom box buttons center container content footer global group header
    inner item items left links list main page panel post reader right section side site slot
    the thread top user wrap wrapper""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of an article and never the whole.
PIECES = HEADINGS | VOID | set("""p li ul ol dl dt dd pre blockquote figure figcaption caption table
    thead tbody tfoot tr th address details summary""".split())
MAIN = ("article", "main")
#: Kinds of tokens.
TEXT, CONTAINER, NAMED, TITLE, PIECE = range(5)
#: Parts that the tokens, and pages, of a host are dealt into.
PARTS = 64
#: Templates of so many hosts are broadcast (each has at most two pages' tokens); those of
#: more meet the pages by host and part.
FEW_HOSTS = 2_000


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


ROOT = _hash("")


class Node:
    """An element: its tag, the element around it, and its place among those of the template."""

    __slots__ = ("chars", "main", "maybe", "name", "noise", "parent", "place", "title")

    def __init__(self, name: str, parent, place: int, noise: bool, maybe: bool):
        self.name, self.parent, self.place = name, parent, place
        self.noise, self.maybe = noise, maybe
        self.main = name in MAIN or parent is not None and parent.main
        self.chars, self.title = 0, name == "h1"

    @property
    def kind(self) -> int:
        if self.name in MAIN:
            return NAMED
        if self.name == "h1":
            return TITLE
        return PIECE if self.name in PIECES else CONTAINER


class Block:
    """A block of text: its words, its element, and how much of it is outside links."""

    __slots__ = ("node", "plain", "text")

    def __init__(self, node: Node, text: str, plain: int):
        self.node, self.text, self.plain = node, text, plain

    @property
    def token(self) -> int:
        return _hash(f"{self.node.place}\0{self.text}")


def _says_noise(names: str) -> bool:
    """Whether a class or id is made of listed words, with neutral parts at most."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if any(p in WORDS for p in parts) and all(
                p in WORDS or p in NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def _settle_noise(nodes: list[Node], blocks: list[Block]) -> None:
    """What is noise, from the outside in, and text outside links and noise per element."""
    for block in blocks:
        block.node.chars += block.plain
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.title |= node.title
    whole = nodes[0].chars
    for node in nodes[1:]:
        spared = node.title and 2 * node.chars > whole
        node.noise |= node.parent.noise or node.maybe and not spared
    for node in nodes:
        node.chars = 0
    for block in blocks:
        if not block.node.noise:
            block.node.chars += block.plain
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars


def read_page(page: str) -> tuple[list[Node], list[Block]]:
    """A page's elements, the page itself first, and its blocks of text, both in order."""
    root = Node("", None, ROOT, False, False)
    nodes, stack = [root], [root]
    blocks: list[Block] = []
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            blocks.append(Block(stack[-1], text, max(0, len(text) - state["linked"])))
        parts.clear()
        state["linked"] = 0

    def close(names, until=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in until:
                return

    def start(name: str, attributes: str):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        close(ENDS.get(name, ()), until=("ul", "ol", "dl", "table"))
        close(("p",), until=("button", "td", "th", "table"))
        around = stack[-1]
        noise = (name in NOT_TEXT and name != "form" or name == "header" and not around.main
                 or found.get("role", "").lower() in ROLES)
        maybe = name == "form" or name not in HEADINGS and name not in ("html", "body", "main") and (
            _says_noise(found.get("class", "")) or _says_noise(found.get("id", "")))
        label = ".".join([name, *sorted(found.get("class", "").split())])
        node = Node(name, around, _hash(f"{around.place}/{label}"), noise, maybe)
        nodes.append(node)
        if name not in VOID:
            stack.append(node)

    at = 0
    for match in _TAG.finditer(page):
        piece = page[at:match.start()]
        at = match.end()
        if piece:
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece)
        name = (match[3] or "").lower()
        if not name or match[2] in ("!", "?"):
            continue
        if name in INLINE:
            if name == "a":
                state["links"] = 0 if match[2] else 1
        elif name == "br":
            parts.append(" ")
        else:
            flush()
            state["links"] = 0
            if match[2]:
                close((name,))
            else:
                start(name, match[4])
    parts.append(page[at:])
    flush()
    _settle_noise(nodes, blocks)
    return nodes, blocks


@dataclass
class Token:
    """A token of a host (or of one page): its kind, vector, and text that is no noise."""

    parent: int
    kind: int
    pages: int
    low: int
    high: int
    v1: int
    v2: int
    chars: int

    @property
    def vector(self) -> tuple[int, int]:
        return self.v1, self.v2


def _counts(nodes: list[Node], blocks: list[Block], r1: int = 1, r2: int = 1) -> dict[int, Token]:
    """Tokens of one page, where its two random numbers are ``r1`` and ``r2``."""
    found: dict[int, Token] = {}

    def seen(token: int, parent: int, kind: int, chars: int):
        held = found.setdefault(token, Token(parent, kind, 1, 0, 0, 0, 0, 0))
        held.low = held.high = held.low + 1
        held.v1 += r1
        held.v2 += r2
        held.chars += chars

    if len(nodes) > 1 or blocks:
        for node in nodes:
            seen(node.place, node.parent.place if node.parent else ROOT, node.kind, node.chars)
        for block in blocks:
            seen(block.token, block.node.place, TEXT, 0 if block.node.noise else block.plain)
    return found


_TOKENS = pa.schema([
    ("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()),
    ("pages", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("v1", pa.int64()), ("v2", pa.int64()), ("chars", pa.int64())])
_TOKENS_SQL = ("host string, token bigint, parent bigint, kind int, pages bigint, low bigint, "
               "high bigint, v1 bigint, v2 bigint, chars bigint")


def _tokens(batches):
    """Occurrence sums of the tokens of a batch's pages."""
    for batch in batches:
        sums: dict[tuple, Token] = {}
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            r1, r2 = key & 0x7FFFFFFF, key >> 32 & 0x7FFFFFFF
            for token, new in _counts(*read_page(page), r1, r2).items():
                held = sums.get((host, token))
                if held is None:
                    sums[host, token] = new
                else:
                    held.pages += 1
                    held.low, held.high = min(held.low, new.low), max(held.high, new.high)
                    held.v1 += new.v1
                    held.v2 += new.v2
                    held.chars += new.chars
        rows = [(*k, t.parent, t.kind, t.pages, t.low, t.high, t.v1, t.v2, t.chars)
                for k, t in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)


def main_slot(tokens: dict[int, Token], several: bool = True) -> tuple[list[int], list[int]]:
    """The main slot with its headings, and the fixed texts, of a template's tokens.

    ``several`` says that vectors are over more than one page, so that texts can be fixed.
    """
    size = Counter(t.vector for t in tokens.values() if several or t.kind != TEXT)

    def around(token: int):
        """A token and those of the elements around it."""
        while token in tokens:
            yield token
            if token == ROOT:
                return
            token = tokens[token].parent

    fixed = [k for k, t in tokens.items() if several and t.kind == TEXT and any(
        tokens[a].vector == t.vector for a in around(t.parent))]
    deciding = {k: t.chars for k, t in tokens.items() if t.kind != TEXT}
    for text in fixed:
        for token in around(tokens[text].parent):
            deciding[token] -= tokens[text].chars
    if not any(deciding.values()):
        deciding, fixed = {k: tokens[k].chars for k in deciding}, []
    most = max(deciding.values(), default=0)
    slots = [k for k, t in tokens.items() if most and t.kind in (CONTAINER, NAMED)
             and (size[t.vector] >= 2 or k == ROOT) and t.low == t.high == 1 and deciding[k] >= MOST * most]
    if not slots:
        return [], fixed
    named = [k for k in slots if tokens[k].kind == NAMED]
    # slots that each hold more than half of the text lie within one another
    slot = max(named or slots, key=lambda k: (sum(1 for _ in around(k)), k))
    titles = [k for k, t in tokens.items() if t.kind == TITLE and deciding[k] > 0
              and t.vector == tokens[slot].vector]
    if 2 * deciding[slot] <= tokens[slot].chars:
        fixed = []
    return [slot, *titles], fixed


_TEMPLATE = "host string, texts array<bigint>, mains array<bigint>"


def _deduce(found: pd.DataFrame) -> pd.DataFrame:
    """The template of a host from its tokens on at least half of the pages."""
    columns = ["parent", "kind", "pages", "low", "high", "v1", "v2", "chars"]
    tokens = {int(k): Token(*map(int, row)) for k, *row in found[["token", *columns]].itertuples(
        index=False, name=None)}
    mains, texts = main_slot(tokens)
    return pd.DataFrame({
        "host": [found["host"].iloc[0]], "texts": [np.array(texts, np.int64)],
        "mains": [np.array(mains, np.int64)]})


def main_text(page: str, texts=(), mains=()) -> str:
    """The main text of a page under its host's template: main slot first, then its headings."""
    nodes, blocks = read_page(page)
    mains = list(mains)
    if not mains or all(n.place != mains[0] for n in nodes):
        texts, (mains, _) = (), main_slot(_counts(nodes, blocks), several=False)
    if not mains:
        return ""
    fixed = set(texts)

    def within(starts) -> set[int]:
        """The elements that start so, and all inside them."""
        held: set[int] = set()
        for node in nodes:
            if starts(node) or node.parent is not None and id(node.parent) in held:
                held.add(id(node))
        return held

    slot = within(lambda n: n.place == mains[0])
    top = [n for n in nodes if n.place == mains[0]]
    named = within(lambda n: n.name in MAIN and not n.noise and id(n) in slot)
    inside = [b for b in blocks if id(b.node) in slot and not b.node.noise]
    held = sum(b.plain for b in inside if id(b.node) in named)
    titles = within(lambda n: n.place in mains[1:])
    if any(n.name not in MAIN for n in top) and held > 0 and held >= MOST * sum(
            b.plain for b in inside):
        # the slot is wider than an article with most of it; its headings stay
        titles |= within(lambda n: n.name == "h1" and id(n) in slot)
        slot = named
    return "\n\n".join(
        b.text for b in blocks if not b.node.noise and (
            id(b.node) in slot or id(b.node) in titles) and b.token not in fixed)


def templates(pages: DataFrame) -> DataFrame:
    """One row per host: hashes of its fixed texts, and of the main slot and its headings."""
    rows = pages.select(
        _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"),
        F.xxhash64("page_id", "html").alias("key"))
    found = rows.mapInArrow(_tokens, _TOKENS_SQL).groupBy("host", "token").agg(
        F.first("parent").alias("parent"), F.first("kind").alias("kind"), F.sum("pages").alias("pages"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"),
        F.sum("chars").alias("chars"))
    # a host's tokens meet its number of pages in many parts, and few of them are left
    count = rows.groupBy("host").agg(F.count(
        F.when(F.trim("html") != "", 1)).alias("total")).where(
        F.col("total") > 1).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    often = found.where(F.col("pages") > 1).withColumn(
        "part", F.pmod("token", F.lit(PARTS)).cast("int")).join(count, ["host", "part"]).where(
        F.col("pages") * 2 >= F.col("total"))
    return often.drop("part").groupBy("host").applyInPandas(_deduce, _TEMPLATE)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
                              F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = write_scratch(templates(pages), "templates")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                     ("n_chars", pa.int64())])

    def extracted(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "texts", "mains")))
            texts = [main_text(page, t or (), m or ()) for page, t, m in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], schema=out)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                        _host().alias("host"))
    if known.count() <= FEW_HOSTS:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        spread = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = rows.withColumn("part", F.pmod(
            F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")).join(
            spread, ["host", "part"], "left")
    return joined.select(
        "page_id", "url", "html", "texts", "mains").mapInArrow(
        extracted, "page_id bigint, url string, text string, n_chars bigint")
