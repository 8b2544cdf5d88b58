"""Plan-shape checks: the page pipeline shuffles once, caps use WindowGroupLimit,
scans are pruned, and no nested-loop or cartesian joins appear."""
from conftest import pages_df
from quire.operators.html import content_root, html_tokens, placed_tokens, strip_noise, page_items
from quire.operators.links import detect_chapters


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_and_places_need_no_exchange(spark):
    df = pages_df(spark, [(1, "u", "<article><p>a</p></article>")])
    for tokens in (html_tokens(df), strip_noise(df), content_root(df), placed_tokens(df, "items"), placed_tokens(df, "links")):
        assert "Exchange" not in _plan(tokens)


def test_items_and_links_have_one_exchange_without_html(spark):
    df = pages_df(spark, [(1, "u", "<article><p>a</p></article>")])
    for rows in (page_items(df, include_images=True), detect_chapters(df, 3)):
        plan = _plan(rows)
        assert plan.count("Exchange") == 1
        below = plan[plan.index("Exchange"):].split("\n")[1]
        assert "html" not in below and "tks" not in below


def test_link_cap_uses_window_group_limit(spark):
    df = pages_df(spark, [(1, "http://x/", "<article><ul><li><a href='/a'>a</a></li></ul></article>")])
    opt = detect_chapters(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in opt


def test_scan_prunes_html(spark, tmp_path):
    p = str(tmp_path / "pages")
    pages_df(spark, [(1, "http://x/a", "<p>x</p>")]).write.parquet(p)
    from quire.functions import urls as U
    from pyspark.sql import functions as F
    q = spark.read.parquet(p).select("page_id", U.url_slug(F.col("url")).alias("s"))
    plan = _plan(q)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_no_nested_loop_joins_in_book_build(spark):
    from quire.plans.books import BookConfig, build_books
    pages = pages_df(spark, [(1, "https://s/b/", "<article><p>begin-here:</p><ul><li><a href='/c/'>C</a></li></ul></article>"),
                             (2, "https://s/c/", "<article><p>begin-here: c</p></article>")])
    books = spark.createDataFrame([(1, "https://s/b/", "B", "english", "main", "c", "b.docx")],
                                  "book_id long, url string, title string, language string, book_type string, "
                                  "config_id string, out_name string")
    run = build_books(pages, books, BookConfig(["begin-here:"], [], [], max_depth=2))
    plan = _plan(run.lines)
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
