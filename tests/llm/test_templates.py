"""Template deduction: pages of known texts, and classes formed from whole vectors."""

from collections import Counter, defaultdict

import pytest

from liftengine.llm import templates
from tests.llm.test_cases import page, varied

SCHEMA = "page_id long, url string, html string"


@pytest.fixture
def texts(spark):
    def run(*pages):
        rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
        found = templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()
        return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]
    return run


def around(body, i):
    """A page whose other parts say nothing by their names."""
    return page(f'<div class="k1"><a href="/">Home</a> <a href="/b">About {i}</a></div>{body}'
                f'<div class="k2"><p>{varied(4, 900 + i)}</p></div>')


@pytest.mark.parametrize("start, end", [
    ("<article>", "</article>"), ("<div class='content has-sidebar'>", "</div>"),
    ("<article class='post comments-open'>", "</article>"), ("<div class='k3'>", "</div>")])
def test_one_slot_whatever_its_name(texts, start, end):
    bodies = [(f"Title {i}", varied(60, i), varied(30, 100 + i)) for i in range(6)]
    got = texts(*[around(f"{start}<h1>{a}</h1><p>{b}</p><ul><li>{c}</li></ul>{end}", i)
                  for i, (a, b, c) in enumerate(bodies)])
    assert got == ["\n\n".join(b) for b in bodies]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 12])
def test_equal_pages_keep_their_text(texts, n):
    one = page(f"<article><h1>Title</h1><p>{varied(60, 1)}</p></article><footer>us</footer>")
    assert texts(*[one] * n) == [f"Title\n\n{varied(60, 1)}"] * n


def test_single_page_without_article(texts):
    got, = texts(page(f"<div><h1>A title</h1><p>{varied(80, 1)}</p><ul><li>One</li><li>Two</li></ul>"
                      "<blockquote>Said so.</blockquote></div><nav>Home</nav>"))
    assert got == f"A title\n\n{varied(80, 1)}\n\nOne\n\nTwo\n\nSaid so."


def test_names_that_hold_listed_words(texts):
    got = texts(*[around(f"<div class='k3'><h2 id='social-impact'>Impact {i}</h2><p>{varied(40, i)}</p>"
                         f"<section id='related-work'><p>{varied(30, 50 + i)}</p></section>"
                         f"<div class='cookie-notice'>We use {i}</div>"
                         f"<div id='comments'><p>{varied(90, 70 + i)}</p></div></div>", i)
                  for i in range(4)])
    assert got == [f"Impact {i}\n\n{varied(40, i)}\n\n{varied(30, 50 + i)}" for i in range(4)]


def test_odd_and_empty_pages_of_a_host(texts):
    good = [around(f"<div class='k3'><h1>Title {i}</h1><p>{varied(60, i)}</p></div>", i) for i in range(5)]
    got = texts(*good, "", None, page("<p>Not found.</p>"), around("<div class='k3'></div>", 7))
    assert got[:5] == [f"Title {i}\n\n{varied(60, i)}" for i in range(5)]
    assert got[5:] == ["", "", "Not found.", ""]


def test_heading_of_the_slots_class(texts):
    """A heading outside the slot belongs to it where both have one vector."""
    def pages(titles):
        return [around(f"{'<h1>Title %d</h1>' % i * titles[i]}<div class='k3'><div class='k4'></div>"
                       f"<p>{varied(60, i)}</p></div>", i) for i in range(6)]
    assert texts(*pages([1] * 6)) == [f"Title {i}\n\n{varied(60, i)}" for i in range(6)]
    assert texts(*pages([1, 1, 1, 1, 1, 2])) == [varied(60, i) for i in range(6)]


def test_vectors_choose_the_slot(texts):
    """The same first page: a slot whose element repeats elsewhere on the host bounds no slot."""
    def pages(times):
        return [page(f"<section><div class='k3'><h2>T {i}</h2><p>{varied(50, i)}</p></div>"
                     + "<div class='k3'></div>" * (times * (i > 0)) + f"<p>More {i}.</p></section>")
                for i in range(4)]
    assert texts(*pages(0))[0] == f"T 0\n\n{varied(50, 0)}"
    assert texts(*pages(1))[0] == f"T 0\n\n{varied(50, 0)}\n\nMore 0."


def test_classes_equal_those_of_whole_vectors(spark):
    """Main slots and fixed texts per host from explicit vectors, as lists of counts per page."""
    rows = [(i, f"http://{'abc'[i % 3]}.example/{i}", around(
        f"<div class='k3'><h1>Title {i}</h1><p>{varied(30 + i, i)}</p>" + "<p>More.</p>" * (i % 4)
        + f"<p>Same line of {'abc'[i % 3]}.</p></div>", i)) for i in range(21)]
    got = {r["host"]: (r["mains"], sorted(r["texts"])) for r in templates.templates(
        spark.createDataFrame(rows, SCHEMA)).collect()}
    hosts = defaultdict(list)
    for _, url, html in rows:
        hosts[url[7:16]].append(html)
    assert set(got) == set(hosts)
    for host, pages in hosts.items():
        vectors, parent, kind, chars = defaultdict(lambda: [0] * len(pages)), {}, {}, Counter()
        for i, html in enumerate(pages):
            nodes, blocks = templates.read_page(html)
            for n in nodes:
                vectors[n.place][i] += 1
                parent[n.place], kind[n.place] = n.parent and n.parent.place, n.kind
            for b in blocks:
                vectors[b.token][i] += 1
                parent[b.token], kind[b.token] = b.node.place, templates.TEXT
                chars[b.token] += b.plain * (not b.node.noise)
        often = {k for k, v in vectors.items() if 2 * sum(map(bool, v)) >= len(pages)}
        size = Counter(tuple(vectors[k]) for k in often)

        def chain(token, parent=parent):
            while token is not None:
                yield token
                token = parent[token]

        fixed = [k for k in often if kind[k] == templates.TEXT
                 and any(vectors[a] == vectors[k] for a in list(chain(k))[1:])]
        weight = Counter()
        for k, n in chars.items():
            if k not in fixed:
                for a in list(chain(k))[1:]:
                    weight[a] += n
        slots = [k for k in often if kind[k] in (templates.CONTAINER, templates.NAMED)
                 and set(vectors[k]) <= {0, 1} and size[tuple(vectors[k])] > 1
                 and weight[k] >= templates.MOST * max(weight.values())]
        slot = max(slots, key=lambda k: len(list(chain(k))))
        titles = [k for k in often if kind[k] == templates.TITLE and vectors[k] == vectors[slot]]
        assert (got[host][0][0], sorted(got[host][0][1:])) == (slot, sorted(titles))
        assert got[host][1] == sorted(fixed) and fixed
