"""F-SITE: a four-level captured site derived from the driver tables.

The driver's ``pages`` link only to pages that are not captured, so the link-following
and book operators get their input from this derived site instead.  The fixture only
*writes HTML*; every query then tokenises, slices, follows links and numbers through
the library exactly as it would for real pages.

    level 0  region            https://books.example.org/r{r}/                  (book root)
             its first seven links lead to pages that were never captured
    level 1  nation            .../2024/01/n{n}/            every fifth captured twice; links on to the next nation,
                                                           whose slug is no child's
    level 2  supplier          .../2024/02/n{n}-s{s}/      no page when s_acctbal < 0
             document          .../2024/02/n{n}-d{d}/       every document, under nation doc_id % 25
    level 3  (supplier, part)  .../2024/03/n{n}-s{s}-p{p}/ every distinct pair in lineitem

Parents link to all their children (also to missing ones) in key order; the date path
differs per level so that only the slug decides parenthood.  Level 0-2 bodies are the
lines of a document (doc_id = region/nation/supplier key); level 3 bodies are the part
row and its line items.  Some pages of levels 2 and 3 lack the start or the stop marker.  Every
page has a content heading, a numbered list with italic runs and a line break, an unclosed
table cell and the book's placeholders.  The same SQL shape is given for DuckDB in ``SITE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

BASE = "https://books.example.org"
START_MARKER, STOP_MARKER, REMOVE_LINE = "begin-here:", "finish-here", "All volumes"
SITE_CONFIG = {"start_markers": [START_MARKER], "stop_markers": [STOP_MARKER],
               "remove_text": [REMOVE_LINE], "max_chapters": 150, "max_depth": 3}
L1_ID, L2_ID, L3_ID, DOC_ID, OLD_ID = 10**15, 2 * 10**15, 3 * 10**15, 4 * 10**15, 9 * 10**15
LANGUAGES = ("English", "hindi", "tamil")
PLANNED = "".join(f'<li><a href="/2024/01/x{i}/">Planned {i}</a></li>' for i in range(1, 8))
EXTRA = ('</h2><ol><li>First <i>step</i> of <b><i>two</i></b></li><li>Second<br>half</li></ol><h4>Small</h4>'
         '<p>XXX1 and HHH1</p><table><tr><td>cell a<td>cell b</tr></table>')
OLD_CAPTURE = "<p>An older capture of this address</p>"
OLD_LEVEL = -1                                     # in ``site_parts``; a page of level 1


def _esc(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _doc_body(text):
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.lit("")).otherwise(
        F.concat(F.lit("<p>"), F.replace(_esc(t), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")))


def _li(href, title):
    return F.concat(F.lit('<li><a href="'), href, F.lit('">'), _esc(title), F.lit("</a></li>"))


def _ordered_concat(key, value):
    """Children of one parent concatenated in key order (collect_list has no order)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))),
                                    lambda s: s["v"]), "")


def _page(url_path, title, body, children, start, stop):
    noise = F.concat(
        F.lit('<li><a href="#top">Top</a></li><li><a href="mailto:books@example.org">Mail</a></li>'),
        F.lit('<li><a href="https://elsewhere.example.com'), url_path, F.lit('">Elsewhere</a></li>'),
        F.lit('<li><a href="'), url_path, F.lit('">Table of Contents</a></li>'))
    return F.concat(
        F.lit('<!DOCTYPE html><html><head><title>'), _esc(title),
        F.lit('</title><script>var t="</p>";</script></head><body>'
              '<nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>'), _esc(title),
        F.lit("</h1><p>Before</p><p>"), F.when(start, F.lit(f"Start {START_MARKER} ")).otherwise(F.lit("Unmarked ")), _esc(title), F.lit("</p>"),
        body, F.lit("<h2>Notes on "), _esc(title), F.lit(EXTRA + '<p>Figure<img src="/img/'), _esc(title), F.lit('.png" alt=" Plate ">'
                    '<img src="data:image/png;base64,AAAA"><img src=""><img src="../shared/logo.png"></p>'),
        F.lit(f"<p>{REMOVE_LINE}</p><ul>"), noise, F.coalesce(children, F.lit("")),
        F.lit("</ul>"), F.when(stop, F.lit(f"<p>End {STOP_MARKER}</p>")).otherwise(F.lit("")), F.lit("<p>After</p></article>"
              "<footer>&copy; books &middot; example</footer></body></html>"))


#: What a page of the site is put together from; levels leave out (null) what they have not.
PARTS = ["page_id", "lvl", "url", "title", "text", "children", "nations", "parts", "s_suppkey", "p_name", "p_brand", "p_type", "p_size",
         "items", "start", "stop"]


def site_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived site before its markup is written: one row a page, the columns ``PARTS``."""
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier")
    part = read_table(spark, sf_dir, "part")
    lineitem = read_table(spark, sf_dir, "lineitem")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def dealt(rows, key, tasks=spark.sparkContext.defaultParallelism):
        """Long pages, or very many, come from a few bytes of keys: not all in one task."""
        return rows.repartition(tasks, key)

    n_slug = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    s_slug = F.concat(n_slug, F.lit("-s"), F.col("s_suppkey").cast("string"))
    ns = nation.join(supplier, supplier.s_nationkey == nation.n_nationkey)

    l1_links = nation.groupBy("n_regionkey").agg(_ordered_concat(
        F.col("n_nationkey"), _li(F.concat(F.lit("/2024/01/"), n_slug, F.lit("/")), F.col("n_name"))).alias("children"))
    l2_links = ns.groupBy("n_nationkey").agg(_ordered_concat(
        F.col("s_suppkey"), _li(F.concat(F.lit("/2024/02/"), s_slug, F.lit("/")), F.col("s_name"))).alias("children"))
    # children and line items travel as keys and numbers; their markup is written where the page is
    nations = ns.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("string"))).alias("nations"))
    sold = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))

    p_slug = F.concat(s_slug, F.lit("-p"), F.col("p_partkey").cast("string"))
    r_slug = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    lvl0 = (region.join(l1_links, region.r_regionkey == l1_links.n_regionkey, "left")
            .join(docs, docs.doc_id == region.r_regionkey, "left")
            .select(F.col("r_regionkey").cast("long").alias("page_id"), F.lit(0).alias("lvl"),
                    F.concat(F.lit(BASE + "/"), r_slug, F.lit("/")).alias("url"), F.col("r_name").alias("title"), "text",
                    F.concat(F.lit(PLANNED), F.coalesce("children", F.lit(""))).alias("children")))
    d_slug = F.concat(F.lit("n"), F.col("d_nationkey").cast("string"), F.lit("-d"), F.col("doc_id").cast("string"))
    d_title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    shelf = docs.select("*", (F.col("doc_id") % 25).cast("int").alias("d_nationkey"))
    doc_links = shelf.groupBy("d_nationkey").agg(_ordered_concat(
        F.col("doc_id"), _li(F.concat(F.lit("/2024/02/"), d_slug, F.lit("/")), d_title)).alias("doc_children"))
    lvl2d = shelf.select(
        (F.lit(DOC_ID) + F.col("doc_id")).alias("page_id"), F.lit(2).alias("lvl"),
        F.concat(F.lit(BASE + "/2024/02/"), d_slug, F.lit("/")).alias("url"), d_title.alias("title"), "text",
        (F.col("doc_id") % 7 != 0).alias("start"), (F.col("doc_id") % 5 != 0).alias("stop"))
    next_link = _li(F.concat(F.lit("/2024/01/n"), ((F.col("n_nationkey") + 1) % 25).cast("string"), F.lit("/")), F.lit("Next nation"))
    l1_children = F.concat(F.coalesce("children", F.lit("")), F.coalesce("doc_children", F.lit("")), next_link)
    old = nation.filter(F.col("n_nationkey") % 5 == 0).select(
        (F.lit(OLD_ID) + F.col("n_nationkey")).alias("page_id"), F.lit(OLD_LEVEL).alias("lvl"),
        F.concat(F.lit(BASE + "/2024/01/"), n_slug).alias("url"))
    lvl1 = (dealt(nation, "n_nationkey").join(l2_links, "n_nationkey", "left").join(doc_links, F.col("d_nationkey") == F.col("n_nationkey"), "left")
            .join(docs, docs.doc_id == nation.n_nationkey, "left")
            .select((F.lit(L1_ID) + F.col("n_nationkey")).alias("page_id"), F.lit(1).alias("lvl"),
                    F.concat(F.lit(BASE + "/2024/01/"), n_slug, F.lit("/")).alias("url"), F.col("n_name").alias("title"), "text",
                    l1_children.alias("children")))
    lvl2 = (dealt(ns.filter(F.col("s_acctbal") >= 0), "s_suppkey").join(nations, "s_suppkey", "left").join(sold, "s_suppkey", "left")
            .join(docs, docs.doc_id == F.col("s_suppkey"), "left")
            .select((F.lit(L2_ID) + F.col("s_suppkey")).alias("page_id"), F.lit(2).alias("lvl"),
                    F.concat(F.lit(BASE + "/2024/02/"), s_slug, F.lit("/")).alias("url"), F.col("s_name").alias("title"), "text",
                    "nations", "parts", "s_suppkey",
                    (F.col("s_suppkey") % 7 != 0).alias("start"), (F.col("s_suppkey") % 5 != 0).alias("stop")))
    items = lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"), F.struct(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("bigint").alias("q")).alias("i"))
    # dealt by part: the pairs, their line items and their parts meet in one shuffle.  Whichever side of the
    # join with suppliers is broadcast, the other one is dealt out
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt(items, "p_partkey", n).groupBy("s_suppkey", "p_partkey").agg(F.array_sort(F.collect_list("i")).alias("items"))
    pairs = pairs.join(dealt(ns.select("s_suppkey", "n_nationkey"), "s_suppkey", n), "s_suppkey")
    part_cols = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lvl3 = (pairs.join(part_cols, "p_partkey", "left")
            .select((F.lit(L3_ID) + F.col("s_suppkey") * F.lit(10**9) + F.col("p_partkey")).alias("page_id"),
                    F.lit(3).alias("lvl"),
                    F.concat(F.lit(BASE + "/2024/03/"), p_slug, F.lit("/")).alias("url"),
                    F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title"),
                    "items", "p_name", "p_brand", "p_type", "p_size", (F.col("p_partkey") % 9 != 0).alias("stop")))
    rows = lvl0
    for more in (lvl1, lvl2, lvl2d, lvl3, old):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.select(*PARTS)


def put_together(parts: DataFrame) -> DataFrame:
    """``(page_id, lvl, url, html)`` of the rows of ``site_parts``: what a row's page says follows from the
    row alone, so rows that are filtered out cost no markup."""
    lvl = F.col("lvl")

    def part_link(n, p):
        slug = F.concat(F.lit("n"), n, F.lit("-s"), F.col("s_suppkey").cast("string"), F.lit("-p"), p.cast("string"))
        return _li(F.concat(F.lit("/2024/03/"), slug, F.lit("/")), F.concat(F.lit("Part "), p.cast("string")))

    part_links = F.array_join(F.flatten(F.transform("parts", lambda p: F.transform("nations", lambda n: part_link(n, p)))), "")
    lines = F.array_join(F.transform("items", lambda i: F.concat(
        F.lit("<p>Order "), i["o"].cast("string"), F.lit(" line "), i["l"].cast("string"), F.lit(": "), i["q"].cast("string"), F.lit(" units</p>"))), "")
    body3 = F.concat(F.lit("<p>"), _esc(F.coalesce(F.col("p_name"), F.lit(""))), F.lit("</p><p>Brand "),
                     _esc(F.coalesce(F.col("p_brand"), F.lit(""))), F.lit(", type "),
                     _esc(F.coalesce(F.col("p_type"), F.lit(""))), F.lit(", size "),
                     F.coalesce(F.col("p_size").cast("string"), F.lit("")), F.lit("</p>"),
                     lines)
    body = F.when(lvl == 3, body3).otherwise(_doc_body(F.col("text")))
    children = F.coalesce("children", F.when(F.col("parts").isNotNull(), part_links))
    path = F.substring("url", len(BASE) + 1, 1 << 30)
    # levels 0 and 1 always have both markers, level 3 the first one
    start, stop = (lvl != 2) | F.col("start"), (lvl < 2) | F.col("stop")
    html = F.when(lvl == OLD_LEVEL, F.lit(OLD_CAPTURE)).otherwise(_page(path, F.col("title"), body, children, start, stop))
    return parts.select("page_id", F.when(lvl == OLD_LEVEL, F.lit(1)).otherwise(lvl).alias("lvl"), "url", html.alias("html"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, lvl, url, html)`` of the derived site."""
    return put_together(site_parts(spark, sf_dir))


def site_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book per region root: the manifest rows of F-SITE."""
    region = read_table(spark, sf_dir, "region")
    r_slug = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    return region.select(
        F.col("r_regionkey").cast("long").alias("book_id"),
        F.concat(F.lit(BASE + "/"), r_slug, F.lit("/")).alias("url"),
        F.col("r_name").alias("title"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), F.col("r_regionkey").cast("int") % 3 + 1).alias("language"),
        F.when(F.col("r_regionkey") % 2 == 0, "main").otherwise("other").alias("book_type"), F.lit("site").alias("config_id"),
        F.concat(r_slug, F.lit(".docx")).alias("out_name"))


# The same site in DuckDB SQL (ordered string_agg instead of sorted collect_list).
SITE_SQL = f"""
site_ns AS (
  SELECT n.n_nationkey, n.n_name, n.n_regionkey, s.s_suppkey, s.s_name, s.s_acctbal
  FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey),
site_pairs AS (
  SELECT p.s_suppkey, p.p_partkey, ns.n_nationkey
  FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem) p
  JOIN site_ns ns ON ns.s_suppkey = p.s_suppkey),
site_l1_links AS (
  SELECT n_regionkey, string_agg('<li><a href="/2024/01/n' || n_nationkey || '/">' ||
         replace(replace(n_name, '&', '&amp;'), '<', '&lt;') || '</a></li>', '' ORDER BY n_nationkey) AS children
  FROM nation GROUP BY n_regionkey),
site_l2_links AS (
  SELECT n_nationkey, string_agg('<li><a href="/2024/02/n' || n_nationkey || '-s' || s_suppkey || '/">' ||
         replace(replace(s_name, '&', '&amp;'), '<', '&lt;') || '</a></li>', '' ORDER BY s_suppkey) AS children
  FROM site_ns GROUP BY n_nationkey),
site_l3_links AS (
  SELECT s_suppkey, string_agg('<li><a href="/2024/03/n' || n_nationkey || '-s' || s_suppkey || '-p' || p_partkey
         || '/">Part ' || p_partkey || '</a></li>', '' ORDER BY p_partkey) AS children
  FROM site_pairs GROUP BY s_suppkey),
site_items AS (
  SELECT l_suppkey AS s_suppkey, l_partkey AS p_partkey,
         string_agg('<p>Order ' || l_orderkey || ' line ' || l_linenumber || ': ' ||
                    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' units</p>', ''
                    ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS lines
  FROM lineitem GROUP BY l_suppkey, l_partkey),
site_doc_links AS (
  SELECT doc_id % 25 AS d_nationkey, string_agg('<li><a href="/2024/02/n' || (doc_id % 25) || '-d' || doc_id || '/">Document ' || doc_id || '</a></li>', ''
         ORDER BY doc_id) AS children FROM documents GROUP BY 1),
site_raw AS (
  SELECT CAST(r.r_regionkey AS BIGINT) AS page_id, 0 AS lvl, '{BASE}/r' || r.r_regionkey || '/' AS url,
         '/r' || r.r_regionkey || '/' AS path, r.r_name AS title,
         CASE WHEN coalesce(d.text, '') = '' THEN '' ELSE '<p>' || replace(replace(replace(d.text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' END AS body,
         '{PLANNED}' || coalesce(c.children, '') AS children, true AS starts, true AS stops
  FROM region r LEFT JOIN site_l1_links c ON c.n_regionkey = r.r_regionkey
       LEFT JOIN documents d ON d.doc_id = r.r_regionkey
  UNION ALL
  SELECT {L1_ID} + n.n_nationkey, 1, '{BASE}/2024/01/n' || n.n_nationkey || '/', '/2024/01/n' || n.n_nationkey || '/',
         n.n_name,
         CASE WHEN coalesce(d.text, '') = '' THEN '' ELSE '<p>' || replace(replace(replace(d.text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' END,
         coalesce(c.children, '') || coalesce(dl.children, '') || '<li><a href="/2024/01/n' || ((n.n_nationkey + 1) % 25) || '/">Next nation</a></li>', true, true
  FROM nation n LEFT JOIN site_l2_links c ON c.n_nationkey = n.n_nationkey LEFT JOIN site_doc_links dl ON dl.d_nationkey = n.n_nationkey
       LEFT JOIN documents d ON d.doc_id = n.n_nationkey
  UNION ALL
  SELECT {L2_ID} + ns.s_suppkey, 2, '{BASE}/2024/02/n' || ns.n_nationkey || '-s' || ns.s_suppkey || '/',
         '/2024/02/n' || ns.n_nationkey || '-s' || ns.s_suppkey || '/', ns.s_name,
         CASE WHEN coalesce(d.text, '') = '' THEN '' ELSE '<p>' || replace(replace(replace(d.text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' END,
         coalesce(c.children, ''), ns.s_suppkey % 7 <> 0, ns.s_suppkey % 5 <> 0
  FROM site_ns ns LEFT JOIN site_l3_links c ON c.s_suppkey = ns.s_suppkey
       LEFT JOIN documents d ON d.doc_id = ns.s_suppkey
  WHERE ns.s_acctbal >= 0
  UNION ALL
  SELECT {DOC_ID} + d.doc_id, 2, '{BASE}/2024/02/n' || (d.doc_id % 25) || '-d' || d.doc_id || '/',
         '/2024/02/n' || (d.doc_id % 25) || '-d' || d.doc_id || '/', 'Document ' || d.doc_id,
         CASE WHEN coalesce(d.text, '') = '' THEN '' ELSE '<p>' || replace(replace(replace(d.text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' END,
         '', d.doc_id % 7 <> 0, d.doc_id % 5 <> 0 FROM documents d
  UNION ALL
  SELECT {L3_ID} + sp.s_suppkey * 1000000000 + sp.p_partkey, 3,
         '{BASE}/2024/03/n' || sp.n_nationkey || '-s' || sp.s_suppkey || '-p' || sp.p_partkey || '/',
         '/2024/03/n' || sp.n_nationkey || '-s' || sp.s_suppkey || '-p' || sp.p_partkey || '/',
         'Part ' || sp.p_partkey,
         '<p>' || replace(replace(coalesce(p.p_name, ''), '&', '&amp;'), '<', '&lt;') || '</p><p>Brand ' ||
         replace(replace(coalesce(p.p_brand, ''), '&', '&amp;'), '<', '&lt;') || ', type ' ||
         replace(replace(coalesce(p.p_type, ''), '&', '&amp;'), '<', '&lt;') || ', size ' ||
         coalesce(CAST(p.p_size AS VARCHAR), '') || '</p>' || coalesce(i.lines, ''),
         '', true, sp.p_partkey % 9 <> 0
  FROM site_pairs sp LEFT JOIN part p ON p.p_partkey = sp.p_partkey
       LEFT JOIN site_items i ON i.s_suppkey = sp.s_suppkey AND i.p_partkey = sp.p_partkey),
site AS (
  SELECT page_id, lvl, url,
    '<!DOCTYPE html><html><head><title>' || replace(replace(title, '&', '&amp;'), '<', '&lt;') ||
    '</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>' ||
    replace(replace(title, '&', '&amp;'), '<', '&lt;') || '</h1><p>Before</p><p>' || CASE WHEN starts THEN 'Start {START_MARKER} ' ELSE 'Unmarked ' END ||
    replace(replace(title, '&', '&amp;'), '<', '&lt;') || '</p>' || body ||
    '<h2>Notes on ' || replace(replace(title, '&', '&amp;'), '<', '&lt;') || '{EXTRA}<p>Figure<img src="/img/' || replace(replace(title, '&', '&amp;'), '<', '&lt;') || '.png" alt=" Plate ">' ||
    '<img src="data:image/png;base64,AAAA"><img src=""><img src="../shared/logo.png"></p>' ||
    '<p>{REMOVE_LINE}</p><ul>' ||
    '<li><a href="#top">Top</a></li><li><a href="mailto:books@example.org">Mail</a></li>' ||
    '<li><a href="https://elsewhere.example.com' || path || '">Elsewhere</a></li>' ||
    '<li><a href="' || path || '">Table of Contents</a></li>' || children ||
    '</ul>' || CASE WHEN stops THEN '<p>End {STOP_MARKER}</p>' ELSE '' END || '<p>After</p></article><footer>&copy; books &middot; example</footer></body></html>' AS html
  FROM site_raw
  UNION ALL SELECT {OLD_ID} + n_nationkey, 1, '{BASE}/2024/01/n' || n_nationkey, '{OLD_CAPTURE}' FROM nation WHERE n_nationkey % 5 = 0),
site_books AS (
  SELECT CAST(r_regionkey AS BIGINT) AS book_id, '{BASE}/r' || r_regionkey || '/' AS url, r_name AS title,
         {list(LANGUAGES)}[r_regionkey % 3 + 1] AS language, CASE WHEN r_regionkey % 2 = 0 THEN 'main' ELSE 'other' END AS book_type, 'site' AS config_id, 'r' || r_regionkey || '.docx' AS out_name
  FROM region)
"""
