"""Registered queries: one per operator group of the inventory, each ``(spark, sf_dir)
-> DataFrame`` with flat scalar columns, so results can be checked against SQL.

Every query reads the driver tables (or rows Spark derives from them) in full.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.functions import urls as U
from quire.operators import book as B
from quire.operators import html as H
from quire.operators import links as L
from quire.operators import site as S
from quire.operators import slices as M
from quire.plans.books import ONE_CONFIG, BookConfig, build_books, config_table, paragraphs
from quire.plans.site_fixture import SITE_CONFIG, put_together, site_books, site_pages, site_parts
from quire.session import ensure_checkpoint_dir, written
from quire.sources.tables import (book_manifest, compiled_configs, image_lookup, lines_as_items, marker_table,
                                  parse_configs, read_manifest, read_table, turns_as_items)

# Fixed query parameters (chosen so that every branch of the operators is hit on the
# driver tables; see FIXTURES.md).
LINE_START, LINE_STOP = ["with"], ["that."]
TURN_START, TURN_STOP = ["la"], ["the"]
PAGE_START, PAGE_STOP = ["the"], ["and"]
REMOVE_LINES = ["All rights reserved.", "The and attion to thanedble the, anea. Eriner thanea.", "Wh."]  # M5: a config's list
CHAPTER_CAP = 150                # L5: the configured cap
PAGE_LINK_CAP = 4                # small, so that the cap bites on the driver pages
NAV_KEPT = [t for t in H.STRIP_TAGS if t != "nav"]


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _lines(spark, sf):
    return lines_as_items(_docs(spark, sf))


# ------------------------------------------------------------------ M1-M7 on documents
def q_lines_slice(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M4: document lines between the first ``with`` line (one before) and the
    first later ``that.`` line (excluded)."""
    s = M.slice_items(_lines(spark, sf), LINE_START, LINE_STOP)
    return s.select(F.col("page_id").alias("doc_id"), "idx", "full_text")


def q_lines_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """M2/M3 + A1: per document, slice start/stop (NULL = none) and item counts."""
    b = M.slice_bounds(_lines(spark, sf), LINE_START, LINE_STOP)
    r = B.page_report(b)
    return r.select(F.col("page_id").alias("doc_id"), "items_parsed", "items_sliced", "has_start", "has_stop")


def q_page_report(spark: SparkSession, sf: str) -> DataFrame:
    """A1: per document, items parsed, sliced, removed and kept, and markers not found,
    with the totals of all documents (doc_id NULL)."""
    b = M.slice_bounds(_lines(spark, sf), LINE_START, LINE_STOP)
    r = B.page_report(b, REMOVE_LINES)
    sums = ["items_parsed", "items_sliced", "items_removed", "items_kept", "no_start", "no_stop"]
    return r.rollup(F.col("page_id").alias("doc_id")).agg(*[F.sum(c).alias(c) for c in sums])


def q_lines_remove_text(spark: SparkSession, sf: str) -> DataFrame:
    """M5: slice, then drop lines equal (ignoring case) to one of the removal list."""
    lines = _lines(spark, sf)
    s = M.slice_items(lines, LINE_START, LINE_STOP)
    r = M.remove_text(s.drop("slice_start", "slice_stop"), REMOVE_LINES)
    return r.select(F.col("page_id").alias("doc_id"), "idx", "full_text")


COMMON_FROM = 20                 # documents that share a line for it to be boilerplate


def q_lines_remove_table(spark: SparkSession, sf: str) -> DataFrame:
    """M5 with a list of any size: slices without the lines that many documents share."""
    lines = _lines(spark, sf)
    common = lines.groupBy(F.lower("full_text").alias("text")).agg(F.countDistinct("page_id").alias("n")).filter(F.col("n") >= COMMON_FROM)
    s = M.slice_items(lines, LINE_START, LINE_STOP).drop("slice_start", "slice_stop")
    return M.remove_text(s, common).select(F.col("page_id").alias("doc_id"), "idx", "full_text")


def q_lines_source(spark: SparkSession, sf: str) -> DataFrame:
    """M7: extract_content with a source line (the document's ``source``), renumbered."""
    docs = _docs(spark, sf)
    lines = lines_as_items(docs)
    urls = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"))
    r = M.extract_content(lines, urls, LINE_START, LINE_STOP,
                          REMOVE_LINES)
    return r.select(F.col("page_id").alias("doc_id"), "idx", "full_text")


def q_lines_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """H12 on lines: a line is kept only at its first occurrence in the document."""
    lines = _lines(spark, sf)
    w = Window.partitionBy("page_id", "full_text").orderBy("idx")
    return lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(
        F.col("page_id").alias("doc_id"), "idx", "full_text")


def q_turns_slice(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M4 on conversation turns."""
    t = turns_as_items(read_table(spark, sf, "conversations"))
    s = M.slice_items(t, TURN_START, TURN_STOP)
    return s.select(F.col("page_id").alias("conv_id"), "idx", "role", "full_text")


# ------------------------------------------------------------------ U1-U9
def _pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url", "html")


def q_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """U1, U3-U6 on every captured page URL."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    u = F.col("url")
    return p.select("page_id", "url", U.scheme(u).alias("scheme"), U.netloc(u).alias("netloc"),
                    U.host(u).alias("host"), U.url_defrag(u).alias("defrag"),
                    U.url_norm_key(U.url_defrag(u)).alias("norm_key"), U.url_slug(U.url_defrag(u)).alias("slug"),
                    U.url_reject_reason(u).alias("reject_reason"))


# Fixed rewrite rules that turn each captured URL into the shapes U1 must judge.
URL_VARIANTS = [
    ("as_is", "{u}"), ("ftp", "ftp{rest}"), ("upper", "HTTPS{rest}"), ("localhost", "http://localhost/{tail}"),
    ("loopback", "http://127.0.0.1:8080/{tail}"), ("any", "http://0.0.0.0/{tail}"), ("v6", "http://[::1]/{tail}"),
    ("no_host", "http:///{tail}"), ("bad_bracket", "http://[bad/{tail}"), ("userinfo", "https://user@{netloc}/{tail}"),
]


def _url_variants(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "pages").select("page_id", "url")
    rest = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*", "")
    tail = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?", "")
    net = U.netloc(F.col("url"))
    frames = []
    for name, pat in URL_VARIANTS:
        pieces, out = pat.replace("}", "{").split("{"), []
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                if piece:
                    out.append(F.lit(piece))
            else:
                out.append({"u": F.col("url"), "rest": rest, "tail": tail, "netloc": net}[piece])
        frames.append(p.select("page_id", F.lit(name).alias("variant"), F.concat(*out).alias("url")))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df


def q_url_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Every captured URL rewritten into ten shapes, each judged."""
    v = _url_variants(spark, sf)
    return v.select("page_id", "variant", "url", U.url_reject_reason(F.col("url")).alias("reject_reason"))


# Fixed href shapes resolved against each captured URL.
HREF_SHAPES = ["chapter-1", "./chapter-1", "../up/x", "../../../../x", "/abs/path", "/a/./b/../c",
               "//cdn.example.org/lib.js", "?page=3", "#frag", "", "sub/dir/", "..", ".",
               "https://other.example.com/p?q=1", "a//b", "/x/y/../.."]


def q_url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every captured URL as base against fixed href shapes."""
    p = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("base"))
    shapes = F.array(*[F.lit(h) for h in HREF_SHAPES])
    x = p.select("page_id", "base", F.posexplode(shapes).alias("shape", "href"))
    x = U.with_resolved_url(x, "base", "href", "resolved")
    return x.select("page_id", "shape", "base", "href", "resolved",
                    U.url_defrag(F.col("resolved")).alias("defrag"))


def q_url_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence per page that mentions its URL and a www address, cut into spans.
    The www address is followed by a no-break space, which ends a URL as whitespace."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    text = F.concat(F.lit("See "), F.col("url"), F.lit(" or www.example.org/"),
                    F.col("page_id").cast("string"), F.lit("\u00a0for more."))
    x = p.select("page_id", F.posexplode(U.url_spans(text)).alias("span_no", "span"))
    return x.select("page_id", "span_no", F.col("span.text").alias("text"), F.col("span.is_url").alias("is_url"))


# ------------------------------------------------------------------ H1-H15 on pages
def q_html_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """H1: token stream of every page (raw-text elements and comments dropped)."""
    t = H.html_tokens(_pages(spark, sf))
    return t.select("page_id", "pos", "kind", "tag", "tk")


def q_html_strip(spark: SparkSession, sf: str) -> DataFrame:
    """H2: tokens left after removing noise elements."""
    return H.strip_noise(_pages(spark, sf)).select("page_id", "pos", "kind", "tag")


def q_html_root(spark: SparkSession, sf: str) -> DataFrame:
    """H3: tokens inside the content root."""
    return H.content_root(_pages(spark, sf)).select("page_id", "pos", "kind", "tag")


def q_page_items(spark: SparkSession, sf: str) -> DataFrame:
    """Content items of every page (with style, runs, bold text)."""
    return H.flat_items(H.page_items(_pages(spark, sf)))


def q_html_runs(spark: SparkSession, sf: str) -> DataFrame:
    """H7/H8: one row per formatted run."""
    it = H.page_items(_pages(spark, sf))
    r = it.select("page_id", "idx", F.posexplode("runs").alias("run_no", "r"))
    return r.select("page_id", "idx", "run_no", F.col("r.text").alias("text"),
                    F.col("r.bold").alias("bold"), F.col("r.italic").alias("italic"))


def q_scrape_page(spark: SparkSession, sf: str) -> DataFrame:
    """M8: items, sliced by ``the`` / ``and``, source line appended, renumbered."""
    p = _pages(spark, sf)
    it = H.page_items(p)
    r = M.extract_content(it, p.select("page_id", "url"), PAGE_START,
                          PAGE_STOP, [])
    return r.select("page_id", "idx", "style", "full_text")


def q_toc_links(spark: SparkSession, sf: str) -> DataFrame:
    """L1/L2: every ``li > a[href]`` of each page body (nav kept), with raw href."""
    a = L.anchors(_pages(spark, sf), strip_tags=NAV_KEPT, root="body")
    return a.select("page_id", "pos", "href", "text")


def q_detect_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter links of each page body (nav kept) at the configured cap."""
    links = L.detect_chapters(_pages(spark, sf), CHAPTER_CAP, strip_tags=NAV_KEPT, root="body")
    return links.select("page_id", "link_no", "title", "url", "norm_url", "slug")


def q_link_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The same at a cap of PAGE_LINK_CAP, which most pages reach."""
    links = L.detect_chapters(_pages(spark, sf), PAGE_LINK_CAP, strip_tags=NAV_KEPT, root="body")
    return links.select("page_id", "link_no", "title", "url", "norm_url", "slug")


def q_link_report(spark: SparkSession, sf: str) -> DataFrame:
    """A2: links per page before the cap, kept, and whether the cap bit."""
    links = L.detect_chapters(_pages(spark, sf), None, strip_tags=NAV_KEPT, root="body", cap=False)
    return B.link_report(links, PAGE_LINK_CAP)


# ------------------------------------------------------------------ site: J/B/S/A
_SITE_CFG = BookConfig.from_dict(SITE_CONFIG)


def _site_run(spark, sf):
    cfg = BookConfig.from_dict({**SITE_CONFIG, "include_images": True})
    return build_books(_captured(spark, sf), site_books(spark, sf), cfg, read=put_together)


def _captured(spark, sf):
    """The derived site as a written table of what its pages are put together from: a job reads its pages several times."""
    return written(site_parts(spark, sf))


def q_site_items(spark: SparkSession, sf: str) -> DataFrame:
    """H13-H15 with images on the derived site."""
    return H.items_by_page(site_pages(spark, sf), include_images=True, flat=True)


def q_site_links(spark: SparkSession, sf: str) -> DataFrame:
    """L6 on the derived site (cap 150; reserved titles, self, external, mailto)."""
    links = L.detect_chapters(site_pages(spark, sf), _SITE_CFG.max_chapters, by_page=True)
    return links.select("page_id", "link_no", "title", "url", "norm_url", "slug")


def q_expand_site(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every book to depth 3 with numbers and bookmarks."""
    s = _site_run(spark, sf).sections
    return s.select("book_id", "n1", "n2", "n3", "level", "title", "url", "page_id", "status",
                    "number_title", "bookmark_id", "bookmark")


def q_book_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every book, numbered per section."""
    return _site_run(spark, sf).lines.drop("runs")


# Templates, styles and images of the derived site's books: fixed values of these queries.
SITE_TEMPLATES = [("main", "english", "main_en.docx"), ("main", "tamil", "main_ta.docx"), ("other", "hindi", "other_hi.docx")]
SITE_FOLDER = "tpl"
SITE_STYLES = [("tpl/main_en.docx", ["Normal", "List Bullet", "Heading 3", "Heading 4"]), ("tpl/main_ta.docx", ["Normal", "List Paragraph"]),
               ("tpl/other_hi.docx", ["Normal"])]
DEFAULT_HEADER, DEFAULT_FOOTER = "Untitled book", "https://books.example.org/"


def _captured_images(lines: DataFrame) -> DataFrame:
    """The bytes of every second image, by its URL's length."""
    urls = lines.filter("kind = 'image'").select(F.col("img_url").alias("url")).distinct()
    return urls.filter(F.length("url") % 2 == 0).select("url", F.encode("url", "UTF-8").alias("content"))


def _paragraphs(spark, sf):
    run = _site_run(spark, sf).keep_lines()
    templates = spark.createDataFrame([(ONE_CONFIG, *t) for t in SITE_TEMPLATES], "config_id string, book_type string, language string, file string")
    folders = spark.createDataFrame([(ONE_CONFIG, SITE_FOLDER)], "config_id string, template_folder string")
    styles = spark.createDataFrame(SITE_STYLES, "template string, styles array<string>")
    return paragraphs(run, templates, folders, styles, _captured_images(run.lines), DEFAULT_HEADER, DEFAULT_FOOTER)


def q_book_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """B12 with J6, J7, S5 and B10: lines with the style their template has, images with bytes,
    headers and footers."""
    return _paragraphs(spark, sf).select("book_id", "n1", "n2", "n3", "line_no", "kind", "template", "style", "used_style",
                                         "bullet_indent", "text", "img_url", "alt", "image_bytes", "font_pt")


def q_book_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every text line: runs, spaces between them, URLs on their own."""
    return B.line_pieces(_paragraphs(spark, sf))


def q_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """A3 in full: missing pages, markers not found, items kept and removed, links cut, images failed."""
    run = _site_run(spark, sf)
    images = written(run.lines.filter("kind = 'image'").select("book_id", "n1", "n2", "n3", "kind", "img_url"))
    return B.run_report(run.sections, run.marked, run.links, images, _captured_images(images))


# Two configs under one manifest; one with a selector of another shape, one that is unknown.
CONFIGS = {"long": BookConfig.from_dict({**SITE_CONFIG, "include_images": True}),
           "short": BookConfig(["NOTES on", "never"], ["figure", "no (such"], ["small"], max_chapters=9, max_depth=2),
           "odd": BookConfig([""], [], [], toc_selector="div.toc a")}
BOOK_CONFIGS = ["long", "short", "long", "odd", "unknown"]


def _config_run(spark, sf):
    books = site_books(spark, sf).withColumn("config_id", F.element_at(F.array(*map(F.lit, BOOK_CONFIGS)), F.col("book_id").cast("int") + 1))
    return build_books(_captured(spark, sf), books, config_table(spark, CONFIGS), read=put_together)


def q_config_book_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Books under two configs in one run (markers, removal list, cap, depth, images)."""
    return _config_run(spark, sf).lines.drop("runs")


def _benchmark_configs(spark, sf):
    """One JSON config per benchmark item, every tenth cut off in the middle."""
    b = read_table(spark, sf, "benchmark")
    words, n = F.split("text", " "), F.col("item_id")
    config = F.to_json(F.struct(
        F.lit("not read").alias("_comment"), F.array(F.get(words, F.lit(0))).alias("start_markers"),
        F.array(F.get(words, F.lit(1)), F.get(words, F.lit(2))).alias("stop_markers"),
        F.array(F.get(F.split("text", "\n"), F.lit(0))).alias("remove_text"),
        F.when(n % 3 == 0, n % 50).alias("max_chapters"), F.when(n % 4 == 0, n % 6).alias("max_depth"),
        F.when(n % 2 == 0, F.when(n % 8 == 0, "nav a.x").otherwise("OL > a[href]")).alias("toc_selector")))
    b = b.select(n.alias("config_id"), F.when(n % 10 == 9, F.substring(config, 1, 40)).otherwise(config).alias("json"))
    return parse_configs(b)


def q_config_markers(spark: SparkSession, sf: str) -> DataFrame:
    """The marker lists of many JSON configs as rows."""
    return marker_table(_benchmark_configs(spark, sf))


def q_config_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults, link selector and depth of many JSON configs."""
    c = compiled_configs(_benchmark_configs(spark, sf))
    return c.select("config_id", "selector", "max_chapters", "max_depth", "include_images", F.size("removed").alias("n_removed"))


def q_manifest_books(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest file with bad and broken rows builds the good books and lists the rest."""
    good = site_books(spark, sf)
    bad = good.select((F.col("book_id") + 100).alias("book_id"), F.when(F.col("book_id") % 2 == 0, F.col("url")).otherwise(
        F.lit("ftp://books.example.org/")).alias("url"), "title", "language", "book_type", "config_id", F.lit("../up.docx").alias("out_name"))
    rows = good.unionByName(bad).select(F.to_json(F.struct(*good.columns)).alias("value"))
    rows = rows.unionByName(good.select(F.concat(F.lit('{"book_id": '), F.col("book_id").cast("string"), F.lit(', "url')).alias("value")))
    path = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    rows.write.text(path)
    manifest = written(read_manifest(spark, path))
    run = build_books(_captured(spark, sf), manifest, config_table(spark, {"site": CONFIGS["long"]}), read=put_together)
    built = run.sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("sections")).select(
        "book_id", F.lit(None).cast("string").alias("reason"), "sections")
    return built.unionByName(run.rejects.select("book_id", "reason", F.lit(None).cast("long").alias("sections")))


def q_render_book(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown text per (book, chapter, sub-chapter)."""
    return B.render_chapters(_site_run(spark, sf).lines)


def q_book_report(spark: SparkSession, sf: str) -> DataFrame:
    """A3: sections and missing pages per book and level, with rollup totals."""
    return B.book_report(_site_run(spark, sf).sections)


def q_toc_preview(spark: SparkSession, sf: str) -> DataFrame:
    """A4: first ten chapters per book and the remaining count."""
    return B.toc_preview(_site_run(spark, sf).sections)


# Fixed output names and book types every captured URL is paired with.
MANIFEST_NAMES = ["book.docx", "Book.DOCX", "../escape.docx", "out/book.pdf", "", "a/b/c.docx"]
MANIFEST_TYPES = ["main", "other", "comic"]


def q_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Each captured URL paired with every output-name and book-type shape,
    judged as a book manifest row (language left empty: defaults to english)."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    names = F.array(*[F.lit(x) for x in MANIFEST_NAMES])
    types = F.array(*[F.lit(x) for x in MANIFEST_TYPES])
    b = p.select("page_id", "url", F.posexplode(names).alias("ni", "out_name"))
    b = b.select("*", F.posexplode(types).alias("ti", "book_type"))
    b = b.select((F.col("page_id") * len(MANIFEST_NAMES) * len(MANIFEST_TYPES)
                  + F.col("ni") * len(MANIFEST_TYPES) + F.col("ti")).alias("book_id"),
                 "url", "out_name", "book_type", F.lit(None).cast("string").alias("language"),
                 F.lit("t").alias("title"), F.lit("site").alias("config_id"))
    m = book_manifest(b)
    return m.select("book_id", "url", "language", "book_type", "out_name", "reject_reason")


def q_toc(spark: SparkSession, sf: str) -> DataFrame:
    """The headings the table of contents lists, levels 1-3 (chapter headings and
    content h1-h3, which the book styles as Heading 3)."""
    return B.toc_entries(_site_run(spark, sf).lines)


# B10's defaults are parameters.
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title"


def q_header_footer(spark: SparkSession, sf: str) -> DataFrame:
    """Header and footer text for one candidate book per captured page (title from
    the page's <title>, blank when absent)."""
    p = read_table(spark, sf, "pages")
    books = p.select(F.col("page_id").alias("book_id"), "url",
                     TX.collapse_ws(TX.decode_entities(F.regexp_extract("html", TITLE_RE, 1))).alias("title"))
    return B.header_footer(books, DEFAULT_HEADER, DEFAULT_FOOTER)


# ------------------------------------------------------------------ S3, S5, J6, J7
# Template files by book type and language, and the styles of each template: fixed
# values of this query; the books come from the captured pages.
TEMPLATES = [("main", "english", "main_en.docx"), ("main", "hindi", "main_hi.docx"), ("other", "english", "other_en.docx")]
STYLES = [("tpl/main_en.docx", ["Normal", "List Bullet", "Heading 3", "Heading 4"]), ("tpl/other_en.docx", ["Normal", "List Paragraph"]),
          ("main_hi.docx", ["Heading 3"])]
FOLDERS = [("a", "tpl"), ("b", "")]
LANGUAGES = ["English", "hindi", "tamil"]


def _config_books(spark, sf) -> DataFrame:
    """One book per captured page, with a type, language and config by its path."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    n = F.length("url")
    return p.select(F.col("page_id").alias("book_id"), F.when(n % 2 == 0, "main").otherwise("other").alias("book_type"),
                    F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (n % 3 + 1).cast("int")).alias("language"),
                    F.when(F.col("url").startswith("https"), "a").otherwise("b").alias("config_id"))


def _template_paths(spark, sf) -> DataFrame:
    templates = spark.createDataFrame([(c, *t) for c, _ in FOLDERS for t in TEMPLATES],
                                      "config_id string, book_type string, language string, file string")
    folders = spark.createDataFrame(FOLDERS, "config_id string, template_folder string")
    return S.template_lookup(_config_books(spark, sf), templates, folders)


def q_template_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The template of one book per captured page."""
    return _template_paths(spark, sf)


def q_style_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The style every item of every page gets from its book's template."""
    items = H.page_items(_pages(spark, sf)).select("page_id", "idx", F.lit("text").alias("kind"), "style", F.col("full_text").alias("text"))
    lines = items.join(_template_paths(spark, sf).withColumnRenamed("book_id", "page_id"), "page_id")
    styles = spark.createDataFrame(STYLES, "template string, styles array<string>")
    return S.available_style(lines, styles).select("page_id", "idx", "template", "style", "used_style", "bullet_indent", "text")


def q_image_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The images of the derived site that were captured, with their content's length."""
    # read twice: written, so that pages are cut into items once
    items = written(H.items_by_page(site_pages(spark, sf), include_images=True, texts=False).select("page_id", "idx", "type", "img_url", "alt"))
    urls = items.select(F.col("img_url").alias("url")).distinct()
    images = urls.filter(F.length("url") % 2 == 0).select("url", F.encode("url", "UTF-8").alias("content"))
    return image_lookup(items, images).select("page_id", "idx", "img_url", "alt", F.length("content").alias("n_bytes"))


QUERIES = {
    "page_report": q_page_report,
    "template_lookup": q_template_lookup,
    "style_fallback": q_style_fallback,
    "image_lookup": q_image_lookup,
    "lines_slice": q_lines_slice,
    "lines_bounds": q_lines_bounds,
    "lines_remove_text": q_lines_remove_text,
    "lines_remove_table": q_lines_remove_table,
    "lines_source": q_lines_source,
    "lines_dedup": q_lines_dedup,
    "turns_slice": q_turns_slice,
    "url_parts": q_url_parts,
    "url_valid": q_url_valid,
    "url_resolve": q_url_resolve,
    "url_spans": q_url_spans,
    "manifest": q_manifest,
    "html_tokens": q_html_tokens,
    "html_strip": q_html_strip,
    "html_root": q_html_root,
    "page_items": q_page_items,
    "html_runs": q_html_runs,
    "scrape_page": q_scrape_page,
    "toc_links": q_toc_links,
    "detect_chapters": q_detect_chapters,
    "link_cap": q_link_cap,
    "link_report": q_link_report,
    "site_items": q_site_items,
    "site_links": q_site_links,
    "expand_site": q_expand_site,
    "book_lines": q_book_lines,
    "render_book": q_render_book,
    "book_report": q_book_report,
    "toc_preview": q_toc_preview,
    "toc": q_toc,
    "header_footer": q_header_footer,
    "config_markers": q_config_markers,
    "config_limits": q_config_limits,
    "config_book_lines": q_config_book_lines,
    "manifest_books": q_manifest_books,
    "book_paragraphs": q_book_paragraphs,
    "book_runs": q_book_runs,
    "run_report": q_run_report,
}
