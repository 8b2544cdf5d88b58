"""Following links: book roots and bounded-depth chapter expansion.

Instead of fetching pages one by one, each depth level is one equi-join of the previous
level's sections with the links of their pages, plus a left join to the captured pages to
find the target page (NULL = the page was not captured: status ``missing``).  Depth is at
most three levels.

Joins are left to the planner: AQE turns a side into a broadcast only when its
runtime size is under ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed
partitions (a hub page shared by many books) with its skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import urls as U


def page_keys(pages: DataFrame) -> DataFrame:
    """``(page_key, page_id)``: one captured page per normalised URL (smallest id),
    so joins on the key never fan out when the same URL was captured twice."""
    return first_captures(key_rows(pages))


def key_rows(pages: DataFrame) -> DataFrame:
    """``(page_key, page_id)`` of every captured page, as they lie."""
    return pages.select(U.url_norm_key(U.url_defrag(F.col("url"))).alias("page_key"), "page_id")


def first_captures(keys: DataFrame) -> DataFrame:
    return keys.groupBy("page_key").agg(F.min("page_id").alias("page_id"))


def key_hash(key: Column) -> Column:
    """What ``wanted_keys`` compares: short enough for very many keys to be broadcast."""
    return F.xxhash64(key).alias("key_hash")


def wanted_keys(keys: DataFrame, hashes: DataFrame) -> DataFrame:
    """``page_keys`` of the ``key_rows`` that some hash stands for (and, by chance, a few others):
    a join on the key itself follows, and no other key is shuffled for it."""
    found = few_rows(keys.withColumn("key_hash", key_hash(F.col("page_key"))), hashes, "key_hash")
    return first_captures(found.drop("key_hash"))


def few_rows(rows: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """The rows with these ids.  ``ids`` is a written table: its size is known when the join is
    planned, so it is broadcast below the session's limit; above it the ids are hashed per
    partition, and the rows are not sorted."""
    limit = ids.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if ids.count() * 16 > limit:
        ids = ids.hint("shuffle_hash")
    return rows.join(ids, by, "left_semi")


def book_roots(books: DataFrame, keys: DataFrame) -> DataFrame:
    """``(book_id, url, title, root_page_id, status)``; status ``missing`` when the
    root URL was not captured."""
    b = books.withColumn("page_key", U.url_norm_key(U.url_defrag(F.col("url"))))
    r = b.join(keys, "page_key", "left").drop("page_key")
    return r.select("book_id", "config_id", "url", "title", F.col("page_id").alias("root_page_id"),
                    F.when(F.col("page_id").isNull(), F.lit("missing")).otherwise(F.lit("ok"))
                    .alias("status"))


#: What a section carries of its book's config.
CONFIG_COLS = ("config_id", "selector", "max_chapters", "max_depth")


def follow_links(parents: DataFrame, links: DataFrame, keys: DataFrame, level: int,
                 child_only: bool) -> DataFrame:
    """One expansion level.

    ``parents``: ``(book_id, config_id, n1, n2, n3, page_id, slug)`` of sections whose page exists,
    with their config's ``selector``, ``max_chapters`` and ``max_depth``, which go on to the children;
    ``links`` of all selectors, uncapped.  Every link within the cap of a parent page becomes a child section (for levels 2 and 3 only links
    whose slug starts with ``parent_slug-``, U7, *after* the page's cap).  Child
    numbering follows link order among the kept links.  The target page is a left join.
    """
    p = parents.select("book_id", *CONFIG_COLS, "n1", "n2", "n3", F.col("page_id").alias("_ppid"),
                       F.col("slug").alias("_pslug"))
    lk = links.select(F.col("page_id").alias("_ppid"), "selector", "link_no", "title", "url", "norm_url", "slug")
    c = p.join(lk, ["_ppid", "selector"]).filter(F.col("link_no") <= F.col("max_chapters"))
    if child_only:
        c = c.filter(U.is_child_slug(F.col("slug"), F.col("_pslug")))
    num_col = {1: "n1", 2: "n2", 3: "n3"}[level]
    part = {1: ["book_id"], 2: ["book_id", "n1"], 3: ["book_id", "n1", "n2"]}[level]
    w = Window.partitionBy(*part).orderBy("link_no")
    c = c.withColumn(num_col, F.row_number().over(w))
    c = c.join(keys.withColumnRenamed("page_key", "norm_url"), "norm_url", "left")
    return c.select("book_id", *CONFIG_COLS, "n1", "n2", "n3", F.lit(level).alias("level"), "title", "url", "slug",
                    "page_id",
                    F.when(F.col("page_id").isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("status"))


def template_lookup(books: DataFrame, templates: DataFrame, folders: DataFrame) -> DataFrame:
    """Template file per book: (book_type, lower(language)); ``other`` uses the
    other set, any other type the main set; unknown language -> NULL (blank document).

    ``templates``: ``(config_id, book_type, language, file)``; ``folders``:
    ``(config_id, template_folder)``.  Both come from configs and are tiny.
    """
    b = books.select("book_id", "config_id",
                     F.when(F.col("book_type") == "other", F.lit("other")).otherwise(F.lit("main"))
                     .alias("_set"), F.lower(F.col("language")).alias("_lang"))
    t = templates.select("config_id", F.col("book_type").alias("_set"),
                         F.lower(F.col("language")).alias("_lang"), "file")
    j = b.join(t, ["config_id", "_set", "_lang"], "left").join(
        folders, "config_id", "left")
    path = F.when(F.col("file").isNull(), F.lit(None).cast("string")).when(
        F.coalesce(F.col("template_folder"), F.lit("")) == "", F.col("file")).otherwise(
        F.concat_ws("/", F.col("template_folder"), F.col("file")))
    return j.select("book_id", path.alias("template"))


# Fallback order of the book writer when a style is missing.
BULLET = "• "
STYLE_FALLBACK = ["List Bullet", "List Paragraph", "Normal"]


def available_style(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """The style used for each line given its book's template styles.

    ``lines``: ``(…, template, style)``; ``styles``: ``(template, styles array)``; a
    book without a template uses the built-in styles given for ``template`` NULL via
    ``coalesce`` by the caller.  Requested style if present, else the first of
    List Bullet, List Paragraph, Normal that is present, else Normal.  A bullet line
    whose style fell back gets a ``• `` prefix and an indent flag.
    """
    j = lines.join(styles.select(F.col("template").alias("_tpl"), F.col("styles").alias("_styles")),
                   lines["template"].eqNullSafe(F.col("_tpl")), "left").drop("_tpl")
    has = lambda s: F.coalesce(F.array_contains(F.col("_styles"), s), F.lit(False))
    chosen = F.when(has(F.col("style")), F.col("style"))
    for fb in STYLE_FALLBACK:
        chosen = chosen.when(has(F.lit(fb)), F.lit(fb))
    chosen = chosen.otherwise(F.lit("Normal"))
    fell_back = F.col("style").startswith("List Bullet") & ~chosen.startswith("List Bullet")
    return j.select(*[c for c in lines.columns], chosen.alias("used_style"),
                    fell_back.alias("bullet_indent")).withColumn(
        "text", F.when(F.col("bullet_indent") & (F.col("kind") == "text"),
                       F.concat(F.lit(BULLET), F.col("text"))).otherwise(F.col("text")))

