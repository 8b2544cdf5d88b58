"""Broken and unusual markup with rows derived by hand from the rules, not from the engine."""
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import html as H
from quire.operators import links as L
from tests.conftest import pages_df

#: html -> [(style, [(run, bold)])]
ITEMS = {
    # a wrapper's close ends a stripped element that it was open around
    "<body><div><aside><p>x</p></div><p>b</p></body>": [("Normal", [("b", False)])],
    "<section><nav><p>x</p></section><p>b</p><nav>y</nav><p>c</p>": [("Normal", [("b", False)]), ("Normal", [("c", False)])],
    # a stray close ends nothing and opens nothing
    "<nav><p>menu1</p></form><p>menu2</p></nav><p>c</p>": [("Normal", [("c", False)])],
    "</nav></nav><nav><p>x</p></nav><p>c</p>": [("Normal", [("c", False)])],
    "<aside><aside><p>x</p></aside><p>y</p></aside><p>c</p>": [("Normal", [("c", False)])],
    # a self-closed stripped element is empty
    "<article><p>a</p><iframe src='x'/><p>b</p></article>": [("Normal", [("a", False)]), ("Normal", [("b", False)])],
    # formatting depths inside a block never fall below zero
    "<p>a</b> <b>c</b></p>": [("Normal", [("a", False), ("c", True)])],
    "<p>a</b></b><b>c</b> d</p>": [("Normal", [("a", False), ("c", True), ("d", False)])],
    "<p>a</span><br>b</p>": [("Normal", [("a", False)]), ("Normal", [("b", False)])],
    "<p>a<span><br>b</span></p>": [("Normal", [("a", False), ("b", False)])],
    # a block child counts wherever it stands among the children
    "<ul><li>own<ul><li>sub</li></ul><p>x</p></li></ul>": [("List Bullet", [("sub", False)]), ("Normal", [("x", False)])],
    "<ul><li>own<ul><li>sub</li></ul></li><li>two</li></ul>": [
        ("List Bullet", [("own", False)]), ("List Bullet", [("sub", False)]), ("List Bullet", [("two", False)])],
    "<ol><li>one<p>x</p></li></ol>": [("Normal", [("x", False)])],
    # character references of any length
    "<p>&#x0000041;&#0000066;&#99999999999999999999; &lbrack; &nbsp</p>": [("Normal", [("AB� &lbrack; &nbsp", False)])],
    # ">" inside a quoted value; a quote that does not follow "=" is a character
    "<p title='a>b'>text</p><p data=it's>don't</p>": [("Normal", [("text", False)]), ("Normal", [("don't", False)])],
    "<p z=\"open>r</p>": [("Normal", [("r", False)])],
    # self-closed and void tags are never open; a stray close closes nothing
    "<p>a<svg><path/></svg><br>b</p>": [("Normal", [("a", False)]), ("Normal", [("b", False)])],
    "<p>a<u><br></u>b<span/><br>c</p>": [("Normal", [("a", False), ("b", False)]), ("Normal", [("c", False)])],
    "<p><b/>a <wbr>b</p><p><i>c</p>d<p>e</i></p>": [
        ("Normal", [("a", False), ("b", False)]), ("Normal", [("c", False)]), ("Normal", [("e", False)])],
    # any block ends an open p: what follows lies outside it
    "<p>text<div>inside</div></p>": [("Normal", [("text", False)])],
    "<p>a<table><tr><td>b</table>c<p>d": [("Normal", [("a", False)]), ("Normal", [("b", False)]), ("Normal", [("d", False)])],
    "<p>a<ul><li>b</ul>c": [("Normal", [("a", False)]), ("List Bullet", [("b", False)])],
    # cells and rows end their like, but not those of an outer table
    "<table><tr><td>a<tr><td>b<td>c</table>": [("Normal", [("a", False)]), ("Normal", [("b", False)]), ("Normal", [("c", False)])],
    "<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>": [("Normal", [("out", False)]), ("Normal", [("in", False)])],
    "<table><tr><td>a</div></li></table><p>b</p>": [("Normal", [("a", False)]), ("Normal", [("b", False)])],
    # an inner list's close tags don't end the outer item: its later text belongs to it
    "<ol><li>one<ul><li>sub</ul>more<li>two</ol>": [
        ("List Number", [("one", False), ("more", False)]), ("List Bullet", [("sub", False)]), ("List Number", [("two", False)])],
    "<ul><li>a</ul></li></ul><ol><div><li>b</div></ol>": [("List Bullet", [("a", False)]), ("List Bullet", [("b", False)])],
    # a block inside an inline tag is no child of the outer block, so both yield items
    "<ul><li>own<a><h4>deep</h4></a></li></ul>": [("List Bullet", [("own", False)]), ("Heading 4", [("deep", False)])],
    # an inline end tag ends nothing around a block
    "<b><p>x</b>y</p></b><p>z</p>": [("Normal", [("x", False), ("y", False)]), ("Normal", [("z", False)])],
    # dt and dd end each other, headings end headings
    "<dl><dt><p>t<dd><p>d</dl>": [("Normal", [("t", False)]), ("Normal", [("d", False)])],
    "<h2>a<h3>b</h2><p>c</p>": [("Heading 3", [("a", False)]), ("Heading 3", [("b", False)]), ("Normal", [("c", False)])],
    # a name is the whole name
    "<p-x>out</p-x><p>a<b-c>n</b-c></p>": [("Normal", [("a", False), ("n", False)])],
}


def test_items(spark):
    pages = pages_df(spark, [(i, "https://h.example/", h) for i, h in enumerate(ITEMS)])
    got = {i: [] for i in range(len(ITEMS))}
    for r in H.page_items(pages).orderBy("page_id", "idx").collect():
        got[r["page_id"]].append((r["style"], [(x["text"], x["bold"]) for x in r["runs"]]))
    assert got == dict(enumerate(ITEMS.values()))


def test_titles_after_a_stray_anchor_close(spark):
    html = "<p>x</a></a></p><ul><li><a href='/c1'>One</a></li><li><a href='/c2'>T<b>wo</b></a> not</li></ul>"
    links = L.detect_chapters(pages_df(spark, [(1, "https://h.example/", html)])).orderBy("link_no").collect()
    assert [(r["title"], r["url"]) for r in links] == [("One", "https://h.example/c1"), ("T wo", "https://h.example/c2")]


#: html -> titles of the links right under a list item
LINKS = {
    "<ul><li><svg><path/></svg><a href='/c1'>One</a></li></ul>": ["One"],
    "<ul><li><i class=icon /><a href='/c1'>One</a></li></ul>": ["One"],
    "<ul><li></span><a href='/c1'>One</a></li></ul>": ["One"],
    "<ul><li><i class=icon></i><a href='/c1'>One<li><a href='/c2'>Two</ul>": ["One", "Two"],
    "<ul><li><span><a href='/c1'>No</a></span><a href='/c2'>Yes</a></li></ul>": ["Yes"],
    "<ul><li><p>x</p><a href='/c1'>One</a><ul><li><a href='/c2'>Sub</a></ul><a href='/c3'>Late</a></ul>": ["One", "Sub", "Late"],
    "<nav/><ul><li><a href='/c1'>a<br/>b</a></li></ul>": ["a b"],
    "<ul></ul><a href='/c1'>out</a><ul><li><div></li><a href='/c2'>x</a></ul>": [],
}


def test_links_under_broken_markup(spark):
    pages = pages_df(spark, [(i, "https://h.example/", h) for i, h in enumerate(LINKS)])
    got = {i: [] for i in range(len(LINKS))}
    for r in L.detect_chapters(pages).orderBy("page_id", "link_no").collect():
        got[r["page_id"]].append(r["title"])
    assert got == dict(enumerate(LINKS.values()))


def test_time_grows_with_the_page_only():
    """Deep nesting, unclosed tags and ends that match nothing: linear in the tags."""
    import time

    from quire.operators import tree

    def seconds(n):
        codes = ["div", "i"] + ["b", ""] * n + ["/i", "/em", "li", "/p"] * n + ["td", "/div"] * n
        tags = [tree.parse_code(c) for c in codes]
        t = time.process_time()
        list(tree.places(tags, frozenset(), "auto", "items"))
        return time.process_time() - t

    seconds(1000)
    assert seconds(80_000) < 20 * max(seconds(10_000), 0.02)


def test_resolved_scheme_is_lower_case(spark):
    df = spark.createDataFrame([("http://a.example/", "HTTPS://h.example/Z"), ("HTTP://a.example/x", "y")], "b string, h string")
    assert [r["u"] for r in U.with_resolved_url(df, "b", "h", "u").collect()] == ["https://h.example/Z", "HTTP://a.example/y"]


def test_missing_title_leaves_text(spark):
    df = spark.createDataFrame([("XXX1 of HHH1", None), ("plain", None), ("XXX1", "T")], "t string, title string")
    assert [r[0] for r in df.select(T.fill_placeholders(F.col("t"), F.col("title"))).collect()] == [" of ", "plain", "T"]


@pytest.mark.parametrize("n", [20_000])
def test_huge_tags_and_texts(spark, n):
    """Long attribute lists and long quoted values neither recurse nor cut the page."""
    html = "<p " + " ".join(f"a{i}='{i}>'" for i in range(n)) + ">kept</p><p>" + "&amp;" * n + "</p>"
    rows = H.page_items(pages_df(spark, [(1, "https://h.example/", html)])).orderBy("idx").collect()
    assert [r["full_text"] for r in rows] == ["kept", "&" * n]
