"""HTML extraction: the parser on hard markup, the alignment against brute force, differencing by nearest URL, hot hosts."""

import html
import re

import numpy as np
import pytest
from tables import SF, rows_of

from threadscope.llm import html_main
from threadscope.llm.catalog import QUERIES

SCHEMA = "page_id long, url string, html string, key string, text string, host string, rank int"


def main(page):
    found = html_main.lines(page)
    use = html_main.MAIN if any(k == html_main.MAIN for _, k in found) else html_main.OPEN
    return [t for t, k in found if k == use]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain  text\n here", ["plain text here"]), ("a<br>b<br/>c", ["a b c"]),
    ("<p>one<p>two<b>x</p><p>y", ["one", "twox", "y"]), ("<p>1 &lt; 2 &amp; 3&nbsp;&#8364; &am</p>", ["1 < 2 & 3 € &am"]),
    ("<p>a < b and a<3</p>", ["a < b and a<3"]), ("<p>a<!-- <p>no</p> -->b</p>c<!-- open", ["ab", "c"]),
    ("<script>var t='</p><p>no';</script><style>p{}</style>yes<noscript>no</noscript><textarea><p>no</textarea>", ["yes"]),
    ("<SCRIPT>x</SCRIPT ><p title='a>b' id=\"q>\">t</p><p class=\"x>lost quote</p>", ["t", "lost quote"]),
    ("yes<script>never closed", ["yes"]), ("yes<div cla", ["yes"]), ("<title>no</title><h1>yes</h1>", ["yes"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><th>3</table>", ["a", "b", "c", "1", "2", "3"]),
    ("<nav>no</nav><header>no</header>yes<footer>no</footer><aside>no</aside><form>no<p>no</form>", ["yes"]),
    ("<div class='top-ad'>no</div><div id=sideBar>no</div><div role=search>no</div><p hidden>no<p style='display: none'>no</p>yes", ["yes"]),
    ("<div class='no-sidebar has-menu shadow header1'>yes</div>", ["yes"]), ("a <span class=ad>no <span>no</span> no</span> b", ["a b"]),
    ("<p>out<article><header><h1>T</h1>by me</header><p>x<aside>no</aside><footer>no</footer><p>y</article>out", ["T", "by me", "x", "y"]),
    ("<article><h1>T</h1>x<section id=comments><article>no</article></section><article>no</article></article>", ["T", "x"]),
    ("<article><h1>T</h1>x</article><article class=card>teaser</article>", ["T", "x"]), ("<article>x</article><article>y</article>", ["x", "y"]),
    ("<section class=comments><article>no</article></section><article class='comment'>no</article><article>x</article>", ["x"]),
    ("<main><h1>T</h1>x<nav>no</nav></main>out", ["T", "x"]), ("<div role='main'>x</div>out", ["x"]),
    ("<div class='page sidebar-left'><article>x</article></div>", ["x"]), ("<nav><article>no</article></nav>yes", ["yes"]),
    ("<article></article>yes", ["yes"]), ("</div></p>a</b></article>b", ["a", "b"]), ("a\u2003b\x85c", ["a b c"]),
])
def test_lines(page, want):
    assert main(page) == want


def test_odd_pages_take_linear_time():
    for page in ("<div>" * 100_000, "<p>" * 100_000, "<a \"" * 50_000, "</b>" * 100_000, "<" * 100_000, "<!" * 50_000, "<ul><li>" * 50_000, "&" * 100_000, "<b><i>" * 50_000 + "x"):
        html_main.lines(page)


@pytest.mark.parametrize("limit", [1 << 30, 4])
def test_alignment(limit):
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = (rng.integers(0, 4, rng.integers(0, 14)).tolist() for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        for pairs in (html_main.common(a, b, limit), html_main.shared(a, b)):
            assert len(pairs) == best[-1, -1] and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def extracted(spark, rows, **how):
    pages = spark.createDataFrame([(i, u, h, "k", "t", "h", 1) for i, u, h in rows], SCHEMA).repartition(3)
    return sorted(html_main.main_text(pages, **how).select("page_id", "url", "text", "n_chars").collect(), key=str)


def test_shared_lines_of_the_nearest_page(spark, monkeypatch):
    """Chrome that no markup tells; every folder has its own, so that only the nearest page shows it. Ranges of four pages."""
    monkeypatch.setattr(html_main, "RANGE", 4)
    rows, want = [], {}
    for i in range(60):
        folder = i // 6
        own = [f"own {i} a", f"own {i} b", "said twice", f"own {i} c", "said twice"]
        top, end = [f"top {folder}", "everywhere"], [f"end {folder}", f"© {folder} & co"]
        rows.append((i, f"https://HOST.example/f{folder}/p{i}?x=1", "".join(f"<div>{html.escape(t)}</div>" for t in top + own + end)))
        want[i] = [own[0], own[1], own[3]]  # the repeated line is shared with the neighbour as well
    rows.append((100, "https://other.example/f0/p1", "<div>top 0</div><div>alone</div>"))
    want[100] = ["top 0", "alone"]
    got = {r["page_id"]: r["text"].split("\n") for r in extracted(spark, rows)}
    assert got == want


def test_copies_and_declared_articles_keep_their_text(spark):
    article = "<article><h1>Same</h1><p>The same passage</p><p>own {}</p></article><p>chrome</p>"
    plain = "<div>menu</div><p>a copied text of some length</p><p>and a second line of it</p>"
    rows = [(1, "http://a.b/1", article.format(1)), (2, "http://a.b/2", article.format(2)), (3, "http://a.b/x/1", plain), (3, "http://a.b/x/1", plain),
            (4, "http://a.b/x/2", plain), (5, None, plain), (6, "no url", plain), (7, "http://a.b/x/3", "<div>menu</div><p>another text</p>"), (None, None, None), (8, "http://a.b", "")]
    got = [(r["page_id"], r["text"]) for r in extracted(spark, rows)]
    whole, cut = "menu\na copied text of some length\nand a second line of it", "a copied text of some length\nand a second line of it"
    want = [(1, "Same\nThe same passage\nown 1"), (2, "Same\nThe same passage\nown 2"), (3, whole), (3, whole), (4, cut), (5, whole), (6, whole), (7, "another text"), (8, ""), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    inside = {r["page_id"]: r["text"] for r in extracted(spark, rows[:2], protect=False)}
    assert inside == {1: "own 1", 2: "own 2"}


def test_pages_that_declare_an_article_are_differenced_too(spark):
    """Lines of every kind are compared; the element then decides on what differencing would delete."""
    page = "<nav>menu</nav><p>open</p><article><h1>Title {0}</h1><p>quoted by both</p><p>own {0} a</p><p>own {0} b</p></article><footer>foot {0}</footer>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in range(3)] + [(9, "http://c.d/", page.format(9))]
    pages = spark.createDataFrame([(i, u, h, "k", "t", "h", 1) for i, u, h in rows], SCHEMA)
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_main.main_text(pages).collect()}
    assert got == {i: (f"Title {i}\nquoted by both\nown {i} a\nown {i} b", 0 if i == 9 else 3) for i, _, _ in rows}
    bare = {r["page_id"]: r["text"] for r in html_main.main_text(pages, protect=False).collect()}
    assert bare[0] == "Title 0\nown 0 a\nown 0 b" and bare[9] == got[9][0]


def test_pages_between_copies_are_differenced(spark, monkeypatch):
    """Every page of a run of copies loses the menu that the pages before and after the run share with it, across ranges and buckets."""
    monkeypatch.setattr(html_main, "RANGE", 4)
    monkeypatch.setattr(html_main, "BUCKET", 8)
    plain = "<div>menu {}</div><p>a copied text of some length</p><p>and a second line of it</p>"
    other = "<div>menu {}</div><p>another text {}</p>"
    rows = []
    for host, n in (("a", 30), ("b", 3), ("c", 1), ("d", 2)):
        rows += [(len(rows), f"http://{host}.x/1/0", other.format(host, host))]
        rows += [(len(rows) + i, f"http://{host}.x/1/{i + 1:02}", plain.format(host)) for i in range(n)]
    rows += [(len(rows) + i, f"http://e.x/{i}", plain.format("e")) for i in range(5)]  # nothing but copies
    rows += [(len(rows) + i, f"http://f.x/{i:02}", plain.format("f")) for i in range(9)] + [(len(rows) + 9, "http://f.x/99", other.format("f", "f"))]
    text = "a copied text of some length\nand a second line of it"
    want = {i: f"menu e\n{text}" if "e.x" in u else text if "copied" in h else f"another text {u[7]}" for i, u, h in rows}
    assert {r["page_id"]: r["text"] for r in extracted(spark, rows)} == want


def test_empty(spark):
    assert extracted(spark, []) == []


def test_pages(spark):
    """The sample's pages: whole article elements, told by another way of reading them."""
    got = sorted(map(tuple, QUERIES["op12_html"](spark, SF).select("page_id", "url", "text", "n_chars").collect()))
    want = []
    for page_id, url, page in rows_of("pages", "page_id, url, html"):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner))]
        text = "\n".join(b for b in blocks if b)
        want.append((page_id, url, text, len(text)))
    assert got == sorted(want)
