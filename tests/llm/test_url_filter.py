from quire.llm import queries
from quire.llm import url_filter as U
from tests.llm import edge


def judge(spark, urls, links=(), rules=queries.URL_RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: r for r in U.judge_urls(pages, spark.createDataFrame(list(links), "src string, dst string"), rules).collect()}


def test_rules(spark):
    got = judge(spark, ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "http://x.org/", "http://x.org", "ftp://b.com/fr/#a",
                        "http://b.com/de/x", "http://notexample.org/es/1", "http://bcom/de/", None, "no scheme/de/"])
    assert [got[i]["rule"] for i in range(10)] == [
        "example.org/es/", "example.org/en/1", "org/", None, "com/fr/", "com/de/", "org/", None, None, None]
    assert [got[i]["verdict"] for i in range(10)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert (got[0]["host"], got[0]["path"], got[1]["path"], got[3]["path"], got[8]["host"], got[9]["path"]) == (
        "a.example.org", "/es/1", "/en/12", "", "", "")


def test_blocks_pass_to_aliases_and_allow_comes_first(spark):
    got = judge(spark, ["http://a.net/1", "http://b.net/2", "http://c.com/de/3", "http://d.net/4", "http://e.com/fr/5", "http://f.com/de/6",
                        "http://www.g.net/7.html?utm_source=q", "http://h.net/8"],
                [("http://a.net/1", "http://b.net/2"), ("http://c.com/de/3", "http://b.net/2"),                     # blocked chain
                 ("http://d.net/4", "http://e.com/fr/5"), ("http://f.com/de/6", "http://d.net/4"),                  # an allow in it
                 ("https://g.net/7", "http://nowhere.com/de/"), (None, "http://h.net/8"), ("http://h.net/8", "http://h.net/8")])
    assert [(got[i]["verdict"], got[i]["verdict_by"]) for i in range(8)] == [
        ("block", "alias"), ("block", "alias"), ("block", "rule"), ("allow", "default"), ("allow", "rule"), ("block", "rule"),
        ("block", "alias"), ("allow", "default")]


def test_declared_links(spark):
    pages = spark.createDataFrame([
        ("http://a.net/x", "<head><LINK rel='canonical' HREF='http://b.com/de/1'></head>"), ("http://c.net/x?q", '<meta http-equiv="refresh" content="0; url=/y">'),
        ("http://d.net/", '<link rel="stylesheet" href="/z">'), (None, '<link rel=canonical href=/q>'), ("http://e.net/", None)], "url string, html string")
    assert sorted(map(tuple, U.declared_links(pages).collect())) == [("http://a.net/x", "http://b.com/de/1"), ("http://c.net/x?q", "http://c.net/y")]


def test_hub_and_edge_rows(spark):
    hub = [(f"http://s{i}.net/{i}", "http://hub.net/") for i in range(300)] + [("http://hub.net/", "http://z.com/de/")]
    got = judge(spark, [s for s, _ in hub], hub)
    assert {r["verdict"] for r in got.values()} == {"block"} and len({r["component"] for r in got.values()}) == 1
    pages = edge.docs(spark).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")
    links = spark.createDataFrame([], "src string, dst string")
    assert U.judge_urls(pages, links, queries.URL_RULES).count() == len(edge.rows())
    assert U.judge_urls(pages.limit(0), links, queries.URL_RULES).count() == 0


def test_declared_links_of_any_shape(spark):
    pages = spark.createDataFrame([
        ("http://a.net/d/x", '<link href="y.html" rel="canonical"><link rel=canonical href="../z">'),
        ("http://b.net/d/x?q", "<meta content='0; url=?id=1' http-equiv='Refresh'><META http-equiv=refresh content=0;url=//c.net/x>"),
        ("http://d.net/x", '<meta name="refresh" content="url=/no"><link rel="alternate" href="/no">')], "url string, html string")
    assert {tuple(r) for r in U.declared_links(pages).collect()} == {
        ("http://a.net/d/x", "http://a.net/d/y.html"), ("http://a.net/d/x", "http://a.net/z"),
        ("http://b.net/d/x?q", "http://b.net/d/x?id=1"), ("http://b.net/d/x?q", "http://c.net/x")}
