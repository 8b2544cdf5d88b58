"""The book job: page store and plans, configs per book, manifest files, paragraphs and reports."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import pages_df
from quire.functions.text import Compiled, marker_pattern, matches_any
from quire.operators.book import line_markdown, line_pieces
from quire.operators.html import RUN_TYPE, page_items
from quire.operators.links import chapter_links, selector_parent
from quire.plans.books import BookConfig, build_books, config_table, reached_pages
from quire.sources.store import read_page_store, write_page_store
from quire.sources.tables import parse_configs, read_manifest

BOOKS = ("book_id long, url string, title string, language string, book_type string, config_id string, out_name string")


def _exchanged(df):
    """Columns that cross an Exchange of the plan."""
    nodes = re.split(r"\n\n", df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    rows = [n for n in nodes if re.match(r"\s*\(\d+\) (Broadcast)?Exchange", n)]
    return [re.search(r"Input \[\d+\]: \[(.*?)\]", n).group(1) for n in rows]


def test_store_moves_no_html(spark, tmp_path):
    """With broadcasts off, joins of a page store with ids deal out ids and kept text only."""
    rows = [(i, f"https://s.example/p{i}/", f"<article><p>text {i}</p><ul><li><a href='/p{i + 1}/'>n</a></li></ul></article>") for i in range(200)]
    spark.sql("DROP TABLE IF EXISTS quire_pages")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        store = write_page_store(pages_df(spark, rows), "quire_pages", 4)
        assert read_page_store(spark, "quire_pages").count() == 200
        ids = spark.range(0, 200, 3).withColumnRenamed("id", "page_id")
        reached = reached_pages(store, ids)
        assert sorted(r.page_id for r in reached.collect()) == list(range(0, 200, 3))
        for job in (reached, chapter_links(reached), page_items(reached)):
            moved = _exchanged(job)
            assert moved and not any("html" in cols for cols in moved)
        assert any("html" in cols for cols in _exchanged(reached_pages(pages_df(spark, rows), ids)))     # what it saves
        run = build_books(store, spark.createDataFrame([(1, "https://s.example/p0/", "T", "english", "main", "c", "b.docx")], BOOKS),
                          BookConfig([""], [], [], max_depth=1))
        assert [(r.title, r.page_id) for r in run.sections.collect()] == [("n", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS quire_pages")


PAGES = [(1, "https://s.example/b/", "<article><p>Begin A</p><p>x<img src='/i.png' alt='(1)'></p><p>end</p><ol><li><a href='/c1/'>C1</a></li></ol>"
             "<ul><li><a href='/c2/'>C2</a></li><li><a href='/c3/'>C3</a></li></ul></article>"),
         (2, "https://s.example/c2/", "<article><p>go B</p><p>see https://x.org/<b>y www.z.org</b> XXX1</p><ul><li><a href='/c2-a/'>A</a></li></ul></article>"),
         (3, "https://s.example/c1/", "<article><p>Begin C1</p></article>"), (4, "https://s.example/c2-a/", "<article><p>go deep</p></article>")]


@pytest.fixture(scope="module")
def run(spark):
    books = spark.createDataFrame([(1, "https://s.example/b/", "One", "english", "main", "first", "a.docx"),
                                   (2, "https://s.example/b/", "Two", "english", "main", "second", "b.docx"),
                                   (3, "https://s.example/b/", "Three", "english", "main", "nowhere", "c.docx"),
                                   (4, "https://s.example/b/", "Four", "english", "main", "odd", "d.docx")], BOOKS)
    configs = config_table(spark, {
        "first": BookConfig(["begin"], ["END"], [], max_chapters=5, max_depth=3, include_images=True, toc_selector="ol > a[href]"),
        "second": BookConfig(["GO", "(a.b"], [], ["SEE"], max_chapters=1, max_depth=2, toc_selector="LI > a"),
        "odd": BookConfig(["go"], [], [], toc_selector="nav a.link")})
    return build_books(pages_df(spark, PAGES), books, configs)


def test_every_book_has_its_own_config(run):
    got = sorted((s.book_id, s.n1, s.n2, s.title, s.status) for s in run.sections.collect())
    # first wants links right under ol, which are none; second under li, one of three; c1 has no child
    assert got == [(2, 1, 0, "C1", "ok")]
    assert sorted((r.book_id, r.reason) for r in run.rejects.collect()) == [(3, "config"), (4, "toc_selector")]
    lines = {}
    for r in run.content.orderBy("page_id", "config_id", "idx").collect():
        lines.setdefault((r.page_id, r.config_id), []).append(r.full_text if r.type == "text" else r.img_url)
    assert lines[(1, "first")] == ["Begin A", "x", "https://s.example/i.png", "Content Source - https://s.example/b/"]
    assert (1, "second") not in lines                                   # no start marker there


def test_compiled_markers_equal_the_list_form(spark):
    texts = ["Begin here", "a.b", "axb", "end(", "", "\\E quoted \\Q", "ÉCOLE"]
    for markers in (["begin"], ["A.B", "END("], [], [""], ["\\E Quoted"], ["école"]):
        df = spark.createDataFrame([(t, markers) for t in texts], "t string, m array<string>")
        df = df.select("t", matches_any(F.col("t"), markers).alias("want"), matches_any(F.col("t"), Compiled(marker_pattern(F.col("m")))).alias("got"))
        assert all(r.want == r.got for r in df.collect()), markers


def test_selectors(spark):
    cases = {"li > a[href]": "li", "a": "", " A[href] ".lower(): "", "OL>a": "ol", "nav a": None, "li > a.x": None, "": None}
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", selector_parent(F.col("s")).alias("p"))
    assert {r.s: r.p for r in df.collect()} == cases
    html = "<ul><li><a href='/1'>1</a></li><li><p><a href='/2'>2</a></p></li></ul><ol><a href='/3'>3</a></ol>"
    links = chapter_links(pages_df(spark, [(1, "https://s.example/", html)]), ["", "li", "ol"]).collect()
    assert sorted((r.selector, r.link_no, r.title) for r in links) == [("", 1, "1"), ("", 2, "2"), ("", 3, "3"), ("li", 1, "1"), ("ol", 1, "3")]


def test_broken_configs_and_manifest_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"start_markers": ["x", null], "max_depth": 2, "_old": 1}'), ("b", '{"start_markers": ["x'),
                                ("c", "[1]"), ("d", None), ("e", "{}")], "config_id string, json string")
    got = {r.config_id: (r.start_markers, r.max_depth, r.max_chapters) for r in parse_configs(df).collect()}
    assert got == {"a": (["x"], 2, 100), "e": ([], 1, 100)}
    (tmp_path / "m.json").write_text('{"book_id": 1, "url": "https://a.example/", "title": "T", "out_name": "a.docx"}\n{"book_id": 2, "url"\n'
                                     '{"book_id": 3, "url": "ftp://a.example/", "title": "T", "out_name": "a.docx"}\n')
    rows = {(r.book_id, r.reject_reason, r.language) for r in read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert rows == {(1, None, "english"), (None, "corrupt", "english"), (3, "scheme", "english")}
    (tmp_path / "m.csv").write_text("book_id,url,title,language,book_type,config_id,out_name\n1,https://a.example/,T,hindi,main,c,a.docx\nx,y\n")
    rows = {(r.book_id, r.reject_reason) for r in read_manifest(spark, str(tmp_path / "m.csv"), "csv").collect()}
    assert rows == {(1, None), (None, "corrupt")}


def test_pieces_split_runs_at_urls(spark):
    runs = [(1, "see https://x.org/", False, False), (2, "y www.z.org now", True, False)]
    df = spark.createDataFrame([(1, 1, 0, 0, 1, "text", "t", runs, True), (1, 1, 0, 0, 2, "text", "plain", None, False)],
                               f"book_id long, n1 int, n2 int, n3 int, line_no int, kind string, text string, runs {RUN_TYPE}, bullet_indent boolean")
    got = [(r.line_no, r.piece_no, r.text, r.bold, r.is_url) for r in line_pieces(df).orderBy("line_no", "piece_no").collect()]
    assert got == [(1, 0, "• see ", False, False), (1, 1, "https://x.org/", False, True), (1, 2, " ", False, False), (1, 3, "y ", True, False),
                   (1, 4, "www.z.org", True, True), (1, 5, " now", True, False), (2, 0, "plain", False, False)]


def test_markdown_is_escaped(spark):
    df = spark.createDataFrame([("text", "Normal", "a*b_c # [x](y)", None, None), ("text", "Normal", "1. not a list", None, None),
                                ("text", "List Bullet", "- x", None, None), ("image", None, None, "http://i/a (1).png", "Fig [2]"),
                                ("heading", "Heading 1", "1. A*", None, None), ("text", "Normal", "# no", None, None)],
                               "kind string, style string, text string, img string, alt string")
    md = df.select(line_markdown(*[F.col(c) for c in ("kind", "style", "text", "img")], alt=F.col("alt")).alias("m"))
    assert [r.m for r in md.collect()] == [r"a\*b\_c # \[x\](y)", r"1\. not a list", r"- \- x", r"![Fig \[2\]](http://i/a%20%281%29.png)",
                                           r"## 1. A\*", r"\# no"]


def test_every_branch_occurs_on_the_derived_site(spark):
    from quire.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    run = Q._site_run(spark, sf)
    lines = run.lines.select("kind", "style", "text", "font_pt", "n1", "n2").cache()
    assert lines.filter("font_pt = 14").count() and lines.filter("style = 'List Number'").count()
    assert lines.filter("kind = 'text' AND style = 'Heading 3'").count()                     # content headings for the contents table
    assert lines.filter("text LIKE '%AFRICA and AFRICA%'").count() and not lines.filter("text LIKE '%XXX1%'").count()
    per_book = run.sections.filter("level = 1").groupBy("book_id").count().collect()
    assert all(r["count"] > 10 for r in per_book)
    # A nation links to the next one, which is no child of it
    nation = run.links.filter("title = 'Next nation'").count()
    assert nation and not run.sections.filter("title = 'Next nation'").count()
    total = Q.q_run_report(spark, sf).filter("book_id IS NULL").first()
    assert total.no_start and total.no_stop and total.removed and total.missing and total.images_failed
