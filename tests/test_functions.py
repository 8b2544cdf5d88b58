"""Column functions: whitespace, entities, URLs (U1-U9), bookmarks."""
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U


def _one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).first().y


def test_collapse_ws_matches_python_split(spark):
    samples = ["  a \t b\n", "a  b", "x y　 z", "\u0085q\u001cr", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r.y for r in df.select(T.collapse_ws(F.col("x")).alias("y")).collect()]
    assert got == [" ".join(s.split()) for s in samples]


def test_decode_entities_one_pass(spark):
    df = spark.createDataFrame([("a &amp;lt; b",), ("&copy; &middot; &nbsp;x",), ("&#65;&#x42;&#x1F600;",),
                                ("&unknown; &amp",), ("no refs",)], "x string")
    got = [r.y for r in df.select(T.decode_entities(F.col("x")).alias("y")).collect()]
    assert got == ["a &lt; b", "© ·  x", "AB\U0001F600", "&unknown; &amp", "no refs"]


HREFS = ["chapter-1", "./chapter-1", "../up/x", "../../../../x", "/abs/path", "/a/./b/../c",
         "//cdn.example.org/lib.js", "?page=3", "#frag", "", "sub/dir/", "..", ".",
         "https://other.example.com/p?q=1", "a//b", "/x/y/../..", "q?x=1#f"]
BASES = ["https://h.example.org/a/b/c?x=1#top", "http://h.example.org", "http://h.example.org/dir/",
         "https://user@h.example.org:8080/p/q.html"]


def test_url_resolve_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string")
    got = U.with_resolved_url(df, "base", "href", "r").collect()
    for r in got:
        assert r.r == urljoin(r.base, r.href), (r.base, r.href, r.r)


def test_url_reject_reasons(spark):
    cases = {"https://example.org/x": None, "HTTPS://example.org/": None, "ftp://example.org/": "scheme",
             "http:///x": "no_host", "http://localhost/": "local_host", "http://127.0.0.1:80/": "local_host",
             "http://[::1]/": "local_host", "http://0.0.0.0/": "local_host", "http://[bad/": "malformed",
             "http://10.0.0.1/": None, "example.org/x": "scheme"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.y for r in df.select("u", U.url_reject_reason(F.col("u")).alias("y")).collect()}
    assert got == cases
    # the accepted ones agree with the standard library's parse
    for u, reason in cases.items():
        if reason is None:
            p = urlparse(u)
            assert p.scheme in ("http", "https") and p.netloc


def test_norm_slug_defrag(spark):
    u = "https://Example.org/2024/01/N5-S12/?q=1#frag"
    df = spark.createDataFrame([(u,)], "u string")
    r = df.select(U.url_defrag(F.col("u")).alias("d")).select(
        "d", U.url_norm_key(F.col("d")).alias("k"), U.url_slug(F.col("d")).alias("s")).first()
    assert r.d == urldefrag(u)[0]
    assert r.k == urldefrag(u)[0].rstrip("/").lower()
    assert r.s == urldefrag(u)[0].rstrip("/").split("/")[-1].lower()


def test_url_spans(spark):
    text = "See https://a.example/x?y=1 and www.b.example/z now"
    df = spark.createDataFrame([(text,)], "t string")
    spans = df.select(U.url_spans(F.col("t")).alias("s")).first().s
    assert [(s.text, s.is_url) for s in spans] == [
        ("See ", False), ("https://a.example/x?y=1", True), (" and ", False),
        ("www.b.example/z", True), (" now", False)]


def test_bookmark_and_placeholders(spark):
    df = spark.createDataFrame([(3, "  Hello, World -- part (2)!  "), (7, "திருவிருத்தம்")], "i int, t string")
    got = [r.b for r in df.select(T.bookmark_name(F.col("i"), F.col("t")).alias("b")).collect()]
    assert got == ["ch_3_Hello_World_part_2", "ch_7_"]
    r = spark.createDataFrame([("XXX1 and HHH1",)], "t string").select(
        T.fill_placeholders(F.col("t"), F.lit("Book")).alias("x")).first().x
    assert r == "Book and Book"


def test_clean_link_title(spark):
    df = spark.createDataFrame([("– • Chapter 1", "u"), ("---", "http://u"), ("", "http://v")], "t string, u string")
    got = [r.x for r in df.select(T.clean_link_title(F.col("t"), F.col("u")).alias("x")).collect()]
    assert got == ["Chapter 1", "http://u", "http://v"]
