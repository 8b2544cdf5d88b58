"""Pages walked one by one give what the token rows of all pages, grouped by id, give."""
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import html as H
from quire.operators import links as L
from quire.operators import walk
from tests.conftest import pages_df

BITS = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<ol class=x>", "</ol>", "<td>", "</td>", "<table>", "</table>", "<tr>", "<h2>", "</h3>", "<b>", "</b>",
        "<EM>", "</em>", "<i>", "</i>", "<br>", "<br/>", "<div>", "</div>", "<div class='post x'>", "<section>", "</section>", "<article>", "</article>", "<main>",
        "</main>", "<body>", "</body>", "<nav>", "</nav>", "<p/>", "<span>", "</span>", "<blockquote>", "<pre>", "<dd>", "<dt>", "<div*>", "<hr>",
        "<button>", "</button>", "<a href='/x/1'>", "<a href=\"../up?q=1#f\">", "<a HREF = /x/1/ >", "<a href>", "<a>", "</a>", "<a/>", "<a href='#t'>",
        "<a href='mailto:a@b'>", "<a href='https://s.example/b'>", "<a href='HTTP://other.example/'>", "<a title=\"x > y < z\" href='/q'>",
        "<img src='/i.png'>", "<img src=' ../a/./b.png' alt='A &amp; B'>", "<img src='data:x'>", "<img src=''>", "<img>", "<img alt=x src=//h/p>",
        "<img src='a?b=1'>", "<script>var t='<p>'</script>", "<style>", "<!-- c <p> -->", "<!DOCTYPE html>", "<?php x >", "<", ">", "<>", "a < b", "< p>", "<p", "<a=\"x>y\">", "<a=\"x>",
        "one", " two  three\n", "　", "&amp;lt; &nbsp;&#65;&#x42;", "&#0; &#xD800; &#x110000; &#99999999; &nosuch; &#xFEFF;", "  ", "Table of Contents",
        "Introduction", "» x", "é"]


RARE = {"<style>", "<nav>", "<p", "<button>", "<", "a < b", "< p>", "<a=\"x>", "<article>", "<main>", "</article>", "</main>", "<div class='post x'>", "</body>", "<a title=\"x > y < z\" href='/q'>"}


def made(n=500, seed=5):
    """Every other page has no odd bits, which would end most of it."""
    r = random.Random(seed)
    few, usual = random.Random(seed + 1), [b for b in BITS if b not in RARE] + ["<p>", "<li>", "one"] * 4
    rows = [(k, f"https://s.example/d{k % 3}/p{k}", "".join(few.choice(BITS) if few.random() < 0.05 * (k % 4) else r.choice(usual) for _ in range(r.randrange(1, 60))))
            for k in range(n)]
    rows += [(n, None, "<p>x<img src=/y><li><a href=/z>z</a>"), (n + 1, "https://s.example/", None), (n + 2, "u", "<p>x<img src=y><li><a href=z>z</a>"), (n + 3, "https://s.example", "")]
    # ids of several pages, and none
    return rows + [(3, "https://s.example/again", "<p>x<b>y</b><li><a href=/z>z</a>"), (None, "https://s.example/n", "<p>n1<li><a href=/n>n</a>"), (None, "https://s.example/m", "<p>n2")]


def told(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("root", ["auto", "body"])
def test_items_are_the_same(spark, root):
    pages = pages_df(spark, made()).repartition(4).cache()
    assert told(H.items_by_page(pages, True, root)) == (want := told(H.page_items(pages, True, root)))
    assert len(want) > 800
    assert told(H.items_by_page(pages, True, root, ["p"], False, flat=True)) == told(H.flat_items(H.page_items(pages, True, root, ["p"], False)))
    assert told(H.items_by_page(pages, True, root, texts=False)) == told(H.page_items(pages, True, root).filter("type = 'image'"))


@pytest.mark.parametrize("cap,root,kind", [(None, "auto", {}), (2, "body", {"parent_tag": ""}), (1, "auto", {"parent_tag": "span", "dedup": False}),
                                            (2, "auto", {"skip_reserved": False, "strip_tags": []})])
def test_links_are_the_same(spark, cap, root, kind):
    pages = pages_df(spark, made()).repartition(4).cache()
    want = told(L.detect_chapters(pages, cap, root=root, **kind))
    assert want and told(L.detect_chapters(pages, cap, root=root, by_page=True, **kind)) == want


def test_many_shared_ids_meet(spark, monkeypatch):
    pages = pages_df(spark, [(k // 2, "https://s.example/", f"<p>t{k}</p>") for k in range(20)])
    monkeypatch.setattr(H, "MOST_SHARED", 5)
    assert H.apart(pages)[0] is None
    assert told(H.items_by_page(pages)) == told(H.page_items(pages))


def test_deep_and_long_pages(spark):
    rows = [(1, "https://s.example/", "<div><p>" * 300 + "x" + "</p></div>" * 300 + "<p>" + "<b>y</b>" * 3000),
            (2, "https://s.example/", "<ul>" + "".join(f"<li><a href='/k{i % 200}'>t{i}</a><ul><li>u" for i in range(300)))]
    pages = pages_df(spark, rows)
    assert told(H.items_by_page(pages)) == told(H.page_items(pages))
    for cap in (1, 150, 500):
        assert told(L.detect_chapters(pages, cap, by_page=True)) == told(L.detect_chapters(pages, cap))


def test_steps_are_forgotten(monkeypatch):
    pages = [h for _, _, h in made(300) if h]
    fresh = [walk.Walker(frozenset(H.STRIP_TAGS), "auto").items(h, True, True) for h in pages]
    monkeypatch.setattr(walk, "MOST_STEPS", 20)
    walker = walk.Walker(frozenset(H.STRIP_TAGS), "auto")
    assert [walker.items(h, True, True) for h in pages] == fresh


def test_alone_pages_shuffle_nothing(spark):
    pages = pages_df(spark, [(1, "https://s.example/", "<p>a</p>")])
    alone, meet = H.apart(pages)
    plan = H.items_by_page(pages, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "isnull(page_id" in plan[plan.index("Exchange"):].lower()
    assert alone.count() == 1 and meet.count() == 0


def test_plain_links_are_resolved_the_same(spark):
    bases = ["https://s.example/a/b", "https://s.example", "HTTP://S.example//x//y/", "file:/x/y", "https://s.example/p?q/r#f/g", "s.example/x", "https://s.example/é/"]
    hrefs = ["/a", "a", "./a", "../a", "../../../a", "/../a/./b/..", "a/..", ".", "..", "a//b", "//h/a", "http://h", "https://H/a/../b", "HTTPS://h/a", "ftp://h", "a:b", "a?b",
             "?b", "/a?b#c", "#c", "http://h#f", "http://h/?a", "a b", "...", "/a/...", "/.a", "é"]
    rows = [(i * 100 + j, b, h) for i, b in enumerate(bases) for j, h in enumerate(hrefs)]
    df = U.with_resolved_url(spark.createDataFrame(rows, "i int, b string, h string"), "b", "h", "u")
    plain = 0
    for r in df.collect():
        base = walk.split_base(r.b)
        got = base and walk.resolved(base, r.h)
        plain += got is not None
        assert got is None or got == r.u, (r.b, r.h)
    assert plain > 60


def test_entities_are_decoded_the_same(spark):
    texts = ["&amp;lt;", "&#x1F600;&#128512;", "&#0000000065;", "&#;", "&#x;", "&#xZ;", "&apos;&Auml;&auml;&AMP;", "&#xFFFF; &#65534; &#xFEFF;a", "&#1114112;&#55296;&#x7FFFFFF;", "&a", "&&amp;;"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", T.decode_entities(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == [walk.decoded(r.t) for r in got]
