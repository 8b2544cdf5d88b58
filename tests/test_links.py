"""Link detection L1-L6, including the order traps T4 and T5."""
from conftest import pages_df
from quire.operators.links import detect_chapters

PAGE = ("<body><article><ul>"
        "<li><a href='c'>– Chap C</a></li>"
        "<li><a href='/x#f'>Introduction</a></li>"       # uses up /x (T4)
        "<li><a href='/X/'>X again</a></li>"              # same key as /x -> dropped
        "<li><a href='mailto:a@b'>m</a></li><li><a href='#top'>t</a></li><li><a href='javascript:x()'>j</a></li>"
        "<li><a href='http://other.example/z'>ext</a></li>"
        "<li><b>1.</b> <a href='../up/'>Up</a></li>"
        "<li><a href='/a/b'>self</a></li>"
        "<li><a href='d'></a></li>"
        "<li><a>no href</a></li>"
        "</ul><p><a href='/not-in-li'>p</a></p></article>"
        "<nav><ul><li><a href='/nav'>nav</a></li></ul></nav></body>")


def test_detect_chapters_rules(spark):
    df = pages_df(spark, [(1, "http://x.org/a/b/", PAGE)])
    got = [(r.link_no, r.title, r.url, r.slug) for r in detect_chapters(df).orderBy("link_no").collect()]
    assert got == [(1, "Chap C", "http://x.org/a/b/c", "c"),
                   (2, "Up", "http://x.org/a/up/", "up"),
                   (3, "http://x.org/a/b/d", "http://x.org/a/b/d", "d")]


def test_cap_counts_kept_links_and_is_at_least_one(spark):
    df = pages_df(spark, [(1, "http://x.org/a/b/", PAGE)])
    assert detect_chapters(df, 2).count() == 2
    assert detect_chapters(df, 0).count() == 1


def test_nav_links_when_nav_kept(spark):
    df = pages_df(spark, [(1, "http://x.org/a/b/", PAGE)])
    from quire.operators.html import STRIP_TAGS
    got = detect_chapters(df, strip_tags=[t for t in STRIP_TAGS if t != "nav"], root="body")
    assert "http://x.org/nav" in {r.url for r in got.collect()}
