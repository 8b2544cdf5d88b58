"""What a book job reads: html of reached pages only, lines once, images apart from text."""
import pytest
from pyspark.sql import functions as F

from quire.operators import book as B
from quire.plans.books import BookConfig, build_books
from quire.plans.queries import _site_run, q_book_paragraphs
from tests.conftest import pages_df
from tests.test_site_pages import sf  # noqa: F401

BASE = "https://b.example.org"
CONFIG = BookConfig(["go"], ["halt"], [], max_depth=2)


def page(title, *links):
    lis = "".join(f'<li><a href="{u}">{t}</a></li>' for u, t in links)
    return f"<body><article><h1>{title}</h1><p>go</p><p>Text of {title}</p><ul>{lis}</ul><p>halt</p></article></body>"


def site(spark):
    return pages_df(spark, [
        (1, f"{BASE}/book/", page("Root", ("/a/x/", "X"), ("/a/gone/", "Gone"))),
        (2, f"{BASE}/a/x/", page("X", ("/b/x-1/", "One"))),
        (3, f"{BASE}/b/x-1/", page("One")),
        (4, f"{BASE}/b/apart/", page("Apart"))])


def told(df, *by):
    return sorted(map(str, df.drop("runs").collect())) if not by else sorted(map(tuple, df.select(*by).collect()))


def test_html_is_made_of_reached_pages_only(spark):
    books = spark.createDataFrame([(1, f"{BASE}/book/", "Book")], "book_id long, url string, title string")
    plain = build_books(site(spark), books, CONFIG)

    def read(rows):
        html = F.when(F.col("page_id") == 4, F.raise_error(F.lit("made for no one")).cast("string")).otherwise(F.reverse("packed"))
        return rows.select("page_id", "url", html.alias("html"))

    packed = site(spark).select("page_id", "url", F.reverse("html").alias("packed"))
    run = build_books(packed, books, CONFIG, read=read)
    assert told(run.sections) == told(plain.sections) and run.sections.count() == 3
    assert told(run.lines) == told(plain.lines) and any("Text of One" in r for r in told(run.lines))
    with pytest.raises(Exception, match="made for no one"):
        read(packed).collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_once(spark, sf):  # noqa: F811
    lines = _site_run(spark, sf).lines
    assert "Exchange" not in plan(B.render_chapters(lines)).split("Window")[0]     # rendered where they were numbered
    assert plan(lines).count("Window") == 1                                       # the content is not numbered before
    got = {(r.n1, r.n2): r.markdown for r in B.render_chapters(lines).collect()}
    for k in ((0, 0), (1, 0)):
        rows = sorted(lines.filter((F.col("n1") == k[0]) & (F.col("n2") == k[1])).collect(), key=lambda r: (r.n3, r.line_no))
        assert got[k].count("\n") == len(rows) - 1


def test_paragraphs_read_written_lines(spark, sf):  # noqa: F811
    out = q_book_paragraphs(spark, sf)
    assert "Window" not in plan(out) and "Generate" not in plan(out)               # numbered once, not per use
    rows = out.collect()
    images = [r for r in rows if r.kind == "image"]
    assert images and all(r.image_bytes == len(r.img_url) and r.image_bytes % 2 == 0 for r in images)
    assert any(r.kind == "text" for r in rows) and all(r.image_bytes is None for r in rows if r.kind != "image")
