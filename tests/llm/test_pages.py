import html
import random
import re

import pytest

from labelaudit.llm import pages as pg

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; title</h1></header>
<p title="a>b">One <b>bold</b>
 word<br>more</p><div class="ad">Buy</div><p>Two &lt;x&gt; &nbsp;y<p>Three</article>
<section id="comments"><article class="comment">Reader</article></section><form><p>Name</p></form>
<footer>&copy; x</footer></body></html>"""


def test_lines_by_markup():
    kept = [t for t, k in pg.lines(PAGE) if k == pg.ARTICLE]
    assert kept == ["Head & title", "One bold word more", "Two <x> y", "Three"]
    assert all(t not in ("T", "no") for t, _ in pg.lines(PAGE))
    assert [t for t, k in pg.lines(PAGE) if k == pg.SIDE] == ["Site name", "Home", "We use cookies", "Buy", "Reader", "Name", "© x"]
    assert pg.lines("") == [] and pg.lines("just text") == [("just text", pg.PLAIN)]
    assert pg.lines("<div class=ad>Buy<article><p>Kept</article>")[1] == ("Kept", pg.ARTICLE)
    assert pg.lines("<p>a<script>never closed <p>b") == [("a", pg.PLAIN)]
    assert pg.lines("<p>a</p><div class='" + "x" * 200_000)[0] == ("a", pg.PLAIN)


def test_names_and_hidden_marks_are_read_whole():
    inside = """<article><div style="overflow:hidden"><p>One</p></div><p>Two <a href="/hidden/valley">in a valley</a> far</p>
        <p title="A hidden gem">Three</p><section id="related-work"><p>Four</p></section><h2 id="social-effects">Five</h2>
        <div class="content has-sidebar"><p>Six</p></div><section id="comments"><p>Seven</p></section>
        <div data-id="ad" data-hidden="1">Eight</div></article>"""
    assert [t for t, k in pg.lines(inside) if k == pg.ARTICLE] == [
        "One", "Two in a valley far", "Three", "Four", "Five", "Six", "Seven", "Eight"]
    gone = """<p hidden>a</p><p style="color:red; display: none">b</p><div STYLE='visibility:hidden'>c</div>
        <div class="siteFooter">d</div><div class="x ad-300">e</div><div id="left-sidebar">f</div><p class=share-buttons>g</p>"""
    assert [k for _, k in pg.lines(gone)] == [pg.SIDE] * 7
    titled = pg.lines('<h1 class="entry-title">Title</h1><p>First</p><div>Second</div>')
    assert pg.main_text(titled, [1, 2, 3], None) == "Title\n\nFirst\n\nSecond"
    assert [k for _, k in pg.lines('<p>x</p><div class="entry-content"><p>y</p></div>')] == [pg.PLAIN, pg.BODY]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[k] + 1 if x == y else 0, row[k + 1], 0) for k, y in enumerate(b)]
        for k in range(1, len(row)):
            row[k] = max(row[k], row[k - 1])
    return row[-1]


def test_common_lines_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        places = sorted(pg.common_lines(a, b))
        assert len(places) == lcs_length(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[k] for k in places))


def test_urls():
    assert pg.split_url("http://A.b/c/d.html?x=1#y") == ("a.b", "c/d")
    assert pg.split_url("http://a.b/c/d/") == ("a.b", "c/d") and pg.split_url(None) == ("", "")


def test_differencing_without_article_marks(spark):
    def page(own, menu=("Home", "About us")):
        return "<body>" + "".join(f"<div>{x}</div>" for x in (*menu, *own, "All rights reserved")) + "</body>"
    rows = [(1, "http://h.x/a/1", page(["first story", "and more"])), (2, "http://h.x/a/2", page(["second story"])),
            (3, "http://h.x/b/9", page(["third"])), (4, "http://h.x/b/9#top", page(["third"])),
            (5, "http://other.x/a", page(["alone"])), (6, None, page(["no url"])), (7, "http://h.x/0", None),
            (8, "http://g.x/zz", ""), (None, None, None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    for parts in (1, 3, 20):
        got = {r.page_id: r.text for r in pg.extract(df, parts).collect()}
        assert len(got) == 9
        assert got[1] == "first story\n\nand more" and got[2] == "second story"
        assert "third" in (got[3], got[4]) and got[7] == got[8] == got[None] == ""
        assert "alone" in got[5] and "Home" in got[5] and "no url" in got[6]
    assert pg.extract(df.limit(0), 4).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_variants_of_a_path_are_differenced_alike(spark, parts):
    def page(own):
        return "<body>" + "".join(f"<div>{x}</div>" for x in ("Home", "About us", own, "All rights reserved")) + "</body>"
    rows = [(1, "http://h.x/a", page("first")), (2, "http://h.x/z", page("last"))]
    rows += [(10 + k, f"http://h.x/hot?utm_source={k}", page("hot")) for k in range(30)]
    rows += [(50 + k, f"http://q.x/index.php?id={k // 3}", page(f"story {k // 3}")) for k in range(24)]
    rows += [(90 + k, f"http://one.x/p?utm_id={k}", page("only")) for k in range(3)]
    rows += [(100 + k, None, page("none")) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pg.extract(df, parts).collect()}
    assert len(got) == len(rows) and got[1] == "first" and got[2] == "last"
    assert {got[10 + k] for k in range(30)} == {"hot"}
    assert all(got[50 + k] == f"story {k // 3}" for k in range(24))
    assert all("Home" in got[k] for k in (90, 91, 92, 100, 101, 102))


@pytest.mark.parametrize("parts", [1, 16])
def test_real_pages(spark, sf, parts):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in pg.extract(pages, parts).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)[^>]*>", "\0", body.replace("<br>", " "))).split("\0")
        want = "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, 2**60 + 3, -2**63, None]
    df = spark.createDataFrame([(d, "http://h.x/a", f"<p>{d}</p>") for d in ids], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in pg.extract(df, 2).collect()} == {d: str(d) for d in ids}
