"""Table-of-contents link detection.

Order of operations is part of the semantics and is kept exactly:
href filter (U8) -> resolve + defrag (U2, U3) -> same site (U5) -> first occurrence per
normalised URL (L3) -> title cleanup (L2) -> reserved titles and self links (L4) ->
cap (L5).  A link titled "Introduction" therefore still uses up its URL, and the cap
counts only links that survived the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import walk
from quire.operators.html import STRIP_TAGS, _attr, _has_attr, _kind, apart, placed_tokens, walked

# Fixed values --------------------------------------------------------------
RESERVED_TITLES = ["table of contents", "introduction"]
DEFAULT_MAX_CHAPTERS = 100


#: The selectors a config may name: an anchor right under an element, or any anchor.
SELECTOR_RE = r"^\s*(?:([A-Za-z][A-Za-z0-9-]*)\s*>\s*)?a(?:\[href\])?\s*$"
DEFAULT_SELECTOR = "li > a[href]"


def selector_parent(selector: Column) -> Column:
    """The parent tag of a selector, empty for any, NULL for a selector of another shape."""
    return F.when(selector.rlike(SELECTOR_RE), F.lower(F.regexp_extract(selector, SELECTOR_RE, 1)))


def anchors(pages: DataFrame, parents: list[str] | None = None, strip_tags: list[str] | None = None,
            root: str = "auto") -> DataFrame:
    """L1: anchors with an ``href`` attribute right under one of ``parents`` (default ``li``; an
    empty name among them: under any element).

    ``(page_id, pos, href, base_url, text, up)`` with ``up`` the parent's tag, which comes from the
    page's stack of open elements.  ``text`` is the anchor's text nodes, each stripped, blank ones dropped, joined by
    one space (``get_text(" ", strip)``).  One Exchange, of the anchors and their texts.
    """
    rows = placed_tokens(pages, "links", strip_tags, root, parents or ["li"])
    is_a = F.col("tag") == "a"
    rows = rows.select("page_id", "pos", "own", "up", "tk", F.coalesce(is_a, F.lit(False)).alias("_is_a"),
                       F.when(is_a, F.col("url")).alias("base_url")).filter(F.col("_is_a") | (_kind(F.col("tk")) == "text"))
    rows = rows.repartition("page_id").select(
        "page_id", "pos", "own", "up", "base_url",
        F.when(F.col("_is_a") & _has_attr(F.col("tk"), "href"),
               T.py_strip(T.decode_entities(_attr(F.col("tk"), "href", decode=False)))).alias("href"),
        F.when(~F.col("_is_a"), T.py_strip(T.decode_entities(F.col("tk")))).alias("_text"))
    part = F.when(F.col("_text") != "", F.struct("pos", "_text"))
    a = rows.groupBy("page_id", "own").agg(
        F.first("up").alias("up"), F.first("href", ignorenulls=True).alias("href"), F.first("base_url", ignorenulls=True).alias("base_url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["_text"]), " ").alias("text"))
    return a.filter(F.col("href").isNotNull()).select("page_id", F.col("own").alias("pos"), "href", "base_url", "text", "up")


def page_anchors(pages: DataFrame, parents: list[str], strip_tags: list[str] | None = None, root: str = "auto",
                 skip_reserved: bool = True, most: int | None = None) -> DataFrame:
    """``anchors`` of pages whose id no other page has, without those that ``chapter_links`` drops for sure.  No Exchange."""
    strip = frozenset(STRIP_TAGS if strip_tags is None else strip_tags)
    reserved = tuple(RESERVED_TITLES) if skip_reserved else None
    return walked(pages, walk.anchor_rows(strip, root, frozenset(parents), reserved, most if len(parents) == 1 else None),
                  "pos int, href string, base_url string, text string, up string")


def chapter_links(pages: DataFrame, parents: list[str] | None = None, strip_tags: list[str] | None = None,
                  root: str = "auto", dedup: bool = True, skip_reserved: bool = True, by_page: bool = False,
                  most: int | None = None) -> DataFrame:
    """L1-L4 for several selectors at once: ``links(page_id, selector, link_no, title, url, norm_url,
    slug)``, where ``selector`` is the parent tag (empty: any) and ``link_no`` counts from 1, uncapped.

    ``by_page``, for very many pages: those whose id no other page has are walked one by one, and only links that may
    be kept are shuffled; with ``most`` and one selector, links of a number above it may be missing."""
    parents = parents or ["li"]
    if by_page:
        alone, meet = apart(pages)
        a = anchors(meet, parents, strip_tags, root)
        if alone is not None:
            a = page_anchors(alone, parents, strip_tags, root, skip_reserved, most).unionByName(a)
    else:
        a = anchors(pages, parents, strip_tags, root)
    a = a.filter(U.href_usable(F.col("href")))
    a = U.with_resolved_url(a, "base_url", "href", "url")
    a = a.withColumn("url", U.url_defrag(F.col("url")))
    # equal keys are on one site, so U5 may wait until the window has made the resolved URL a
    # plain column (a filter below it would repeat the whole resolution)
    a = a.withColumn("norm_url", U.url_norm_key(F.col("url"))).withColumn("_same", U.same_site(F.col("url"), F.col("base_url")))
    if len(parents) == 1:
        a = a.withColumn("selector", F.lit(parents[0]))
    else:
        a = a.withColumn("selector", F.explode(F.filter(F.array(*map(F.lit, parents)), lambda x: (x == "") | (x == F.col("up")))))
    if dedup:
        wd = Window.partitionBy("page_id", "selector", "norm_url").orderBy("pos")
        a = a.withColumn("_first", F.row_number().over(wd)).filter((F.col("_first") == 1) & F.col("_same")).drop("_first")
    else:
        a = a.filter("_same")
    a = a.withColumn("title", T.clean_link_title(F.col("text"), F.col("url")))
    if skip_reserved:
        a = a.filter(~F.lower(F.col("title")).isin(*RESERVED_TITLES)
                     & (F.col("norm_url") != U.url_norm_key(F.col("base_url"))))
    wn = Window.partitionBy("page_id", "selector").orderBy("pos")
    return a.select("page_id", "selector", F.row_number().over(wn).alias("link_no"), "title", "url", "norm_url",
                    U.url_slug(F.col("url")).alias("slug"))


def detect_chapters(pages: DataFrame, max_chapters: int | None = DEFAULT_MAX_CHAPTERS,
                    strip_tags: list[str] | None = None, root: str = "auto",
                    parent_tag: str = "li", cap: bool = True, dedup: bool = True, skip_reserved: bool = True,
                    by_page: bool = False) -> DataFrame:
    """``links(page_id, link_no, title, url, norm_url, slug)``, ``link_no`` from 1."""
    most = max(1, int(max_chapters)) if cap and max_chapters is not None else None
    a = chapter_links(pages, [parent_tag], strip_tags, root, dedup, skip_reserved, by_page, most).drop("selector")
    if most is not None:
        a = a.filter(F.col("link_no") <= F.lit(most))
    return a
