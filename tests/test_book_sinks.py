"""S5 image lookup, S6 book writer (only this run's books replaced), B4 TOC, B10."""
from pyspark.sql import functions as F

from quire.operators.book import header_footer, toc_entries, write_books
from quire.sources.tables import image_lookup

LINE_SCHEMA = ("book_id long, n1 int, n2 int, n3 int, line_no int, kind string, style string, "
               "text string, markup string, img_url string, font_pt int")


def test_image_lookup_drops_failed_downloads(spark):
    items = spark.createDataFrame([(1, 0, "image", "http://x/a.png"), (1, 1, "image", "http://x/missing.png"),
                                   (1, 2, "text", None)], "page_id long, idx int, type string, img_url string")
    images = spark.createDataFrame([("http://x/a.png", bytearray(b"\x89PNG"))], "url string, content binary")
    got = [(r.idx, bytes(r.content)) for r in image_lookup(items, images).collect()]
    assert got == [(0, b"\x89PNG")]


def test_write_books_replaces_only_own_books(spark, tmp_path):
    out = str(tmp_path / "books")
    l1 = spark.createDataFrame([(1, 1, 0, 0, 1, "heading", "Heading 1", "1. A", None, None, None),
                                (2, 1, 0, 0, 1, "heading", "Heading 1", "1. B", None, None, None)], LINE_SCHEMA)
    write_books(l1, out)
    l2 = spark.createDataFrame([(1, 1, 0, 0, 1, "heading", "Heading 1", "1. A v2", None, None, None)], LINE_SCHEMA)
    write_books(l2, out)
    got = {(r.book_id, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "## 1. A v2"), (2, "## 1. B")}


def test_toc_entries_include_content_headings(spark):
    lines = spark.createDataFrame([
        (1, 0, 0, 0, 1, "heading", "Heading 1", "Introduction", None, None, None),
        (1, 1, 0, 0, 1, "heading", "Heading 1", "1. A", None, None, None),
        (1, 1, 0, 0, 2, "text", "Heading 3", "content h2", None, None, None),
        (1, 1, 0, 0, 3, "text", "Normal", "body", None, None, None),
        (1, 1, 1, 0, 1, "heading", "Heading 2", "1.1 B", None, None, None)], LINE_SCHEMA)
    got = [(r.toc_level, r.text) for r in toc_entries(lines).orderBy("n1", "n2", "n3", "line_no").collect()]
    assert got == [(1, "Introduction"), (1, "1. A"), (3, "content h2"), (2, "1.1 B")]


def test_header_footer_defaults(spark):
    books = spark.createDataFrame([(1, "T", "https://x/"), (2, "", "")], "book_id long, title string, url string")
    got = {r.book_id: (r.header, r.footer) for r in header_footer(books, "Default header", "https://default/").collect()}
    assert got == {1: ("T", "https://x/"), 2: ("Default header", "https://default/")}
