"""Whole-job plans: captured pages + book manifest -> sections, book lines, report.

``build_books`` wires the operators the way one run of the reference does for one
book, but for every book in the manifest at once, each under its own config:

    books --J1 roots--> L1 --J3--> L2 --J4--> L3 --> sections ----------> book_lines
                links of the pages that a level reaches                    |
    pages of any section --items--> slices per (page, config) --> content -+

Page html is read where it lies: a level joins the ids it needs to the pages, which are broadcast
or, above the session's broadcast limit, dealt out by id; pages in a page store
(``quire.sources.store``) are bucketed by id, so html crosses the network in neither case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import Compiled
from quire.functions.urls import url_defrag, url_norm_key, url_slug
from quire.operators.book import book_lines, header_footer, section_numbers
from quire.operators.html import page_items
from quire.operators.links import DEFAULT_MAX_CHAPTERS, DEFAULT_SELECTOR, chapter_links
from quire.operators.site import (CONFIG_COLS, available_style, book_roots, few_rows, follow_links, key_hash, key_rows,
                                  template_lookup, wanted_keys)
from quire.operators.slices import content_of, marked_items
from quire.session import ensure_checkpoint_dir, written
from quire.sources.tables import compiled_configs


@dataclass
class BookConfig:
    start_markers: list[str]
    stop_markers: list[str]
    remove_text: list[str]
    max_chapters: int = DEFAULT_MAX_CHAPTERS
    max_depth: int = 1
    include_images: bool = False
    toc_selector: str = DEFAULT_SELECTOR

    @classmethod
    def from_dict(cls, d: dict) -> "BookConfig":
        return cls(start_markers=list(d.get("start_markers", [])),
                   stop_markers=list(d.get("stop_markers", [])),
                   remove_text=list(d.get("remove_text", [])),
                   max_chapters=int(d.get("max_chapters", DEFAULT_MAX_CHAPTERS)),
                   max_depth=int(d.get("max_depth", 1)),
                   include_images=bool(d.get("include_images", False)),
                   toc_selector=str(d.get("toc_selector", DEFAULT_SELECTOR)))


#: Makes ``(page_id, url, html)`` of rows that hold what html is made of (a packed body, parts).
PageReader = Callable[[DataFrame], DataFrame]


@dataclass
class BookRun:
    """What a run has written, and what follows from it; items are taken when first asked for."""
    pages: DataFrame
    books: DataFrame
    configs: DataFrame
    links: DataFrame
    roots: DataFrame
    sections: DataFrame
    rejects: DataFrame
    checkpoint: bool = True
    read: PageReader | None = None

    @cached_property
    def marked(self) -> DataFrame:
        """Items of every page some book reaches, under each of its configs, with their slices."""
        root_rows = self._root_rows()
        reach = root_rows.select(F.col("root_page_id").alias("page_id"), "config_id").unionByName(
            self.sections.filter(F.col("page_id").isNotNull()).select("page_id", "config_id")).distinct()
        reach = _cut(reach, self.checkpoint)
        ids = _cut(reach.select("page_id").distinct(), self.checkpoint)
        # of all pages only the reached ones' URLs are shuffled
        urls = few_rows(self.pages.select("page_id", F.col("url").alias("_page_url")), ids, "page_id")
        reach = _cut(reach.join(urls, "page_id").join(
            self.configs.select("config_id", "start_re", "stop_re", "removed", "include_images"), "config_id"), self.checkpoint)
        images = bool(self.configs.agg(F.max("include_images")).first()[0])
        items = page_items(reached_pages(self.pages, ids, self.read), include_images=images)
        # a page's items under each of its configs: without images the others close up
        own = items.join(reach, "page_id").filter((F.col("type") != "image") | F.col("include_images"))
        own = own.withColumn("idx", F.row_number().over(Window.partitionBy(*PER_PAGE).orderBy("idx")) - 1)
        marked = marked_items(own, Compiled(F.col("start_re")), Compiled(F.col("stop_re")), F.col("removed"), PER_PAGE)
        return _cut(marked.select(*items.columns, "config_id", "_page_url", "slice_start", "slice_stop", "_removed"), self.checkpoint)

    @cached_property
    def content(self) -> DataFrame:
        return content_of(self.marked, "_page_url", by=PER_PAGE).drop("_page_url")

    @cached_property
    def lines(self) -> DataFrame:
        # the lines are numbered again per section: the content's own numbers only order them
        content = content_of(self.marked, "_page_url", renumber=False, by=PER_PAGE).drop("_page_url")
        return book_lines(self.books, self.sections, content, self._root_rows())

    def keep_lines(self) -> BookRun:
        """Writes ``lines``, for a job that reads them more than once."""
        self.lines = _cut(self.lines, self.checkpoint)
        return self

    def _root_rows(self) -> DataFrame:
        return self.roots.filter(F.col("root_page_id").isNotNull()).select("book_id", "config_id", "root_page_id")


PER_PAGE = ("page_id", "config_id")


def _cut(df: DataFrame, checkpoint: bool) -> DataFrame:
    return written(df) if checkpoint else df


def paragraphs(run: BookRun, templates: DataFrame, folders: DataFrame, styles: DataFrame, images: DataFrame,
               default_header: str, default_footer: str) -> DataFrame:
    """B12 to the end: book lines as a document writer takes them.

    Text lines get the style that their book's template has (J6, J7: ``used_style``,
    ``bullet_indent``), images their bytes' length (S5; an image without bytes is left out), and
    every book a header and a footer row (B10, ``n1`` -2).  ``images``: ``(url, content)``; the other
    tables as ``template_lookup`` and ``available_style`` take them.  Runs stay in ``runs`` for
    ``line_pieces``."""
    b = template_lookup(run.books, templates, folders)
    lines = run.lines.join(b, "book_id")
    text = F.col("kind") == "text"
    styled = available_style(lines.filter(text), styles)
    # the sign is put before the first run by line_pieces; the text has it already
    other = lines.filter(~text).withColumn("used_style", F.col("style")).withColumn("bullet_indent", F.lit(False))
    sizes = images.select(F.col("url").alias("img_url"), F.octet_length("content").alias("image_bytes")).dropDuplicates(["img_url"])
    # only images meet the table of images: all other lines have the same key, none
    image = F.col("kind") == "image"
    rows = styled.unionByName(other.filter(~image)).withColumn("image_bytes", F.lit(None).cast("int")).unionByName(
        other.filter(image).join(sizes, "img_url"))
    ends = header_footer(run.books, default_header, default_footer).join(b, "book_id")
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema}
    for number, kind in enumerate(("header", "footer"), 1):
        fixed = {"book_id": F.col("book_id"), "template": F.col("template"), "n1": F.lit(-2), "n2": F.lit(0), "n3": F.lit(0),
                 "line_no": F.lit(number), "kind": F.lit(kind), "text": F.col(kind), "bullet_indent": F.lit(False)}
        rows = rows.unionByName(ends.select(*[(fixed[c] if c in fixed else none[c]).alias(c) for c in rows.columns]))
    return rows


CONFIG_ROW = ("config_id string, start_markers array<string>, stop_markers array<string>, remove_text array<string>, "
              "max_chapters int, max_depth int, include_images boolean, toc_selector string")
ONE_CONFIG = "run"


def config_table(spark: SparkSession, configs: dict[str, BookConfig]) -> DataFrame:
    """Configs given in Python as the rows that ``read_config`` gives for files."""
    names = [f.strip().split()[0] for f in CONFIG_ROW.split(",")][1:]
    return spark.createDataFrame([(k, *(asdict(c)[n] for n in names)) for k, c in configs.items()], CONFIG_ROW)


def reached_pages(pages: DataFrame, ids: DataFrame, read: PageReader | None = None) -> DataFrame:
    """The pages with these ids, a written table; html is not sorted.  With ``read``, html is made of the
    reached rows only, after these are dealt out: a row may be short and its page long."""
    found = few_rows(pages, ids, "page_id")
    if read is None:
        return found
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read(found.repartition(tasks, "page_id")).select("page_id", "url", "html")


def gate(books: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books that can be built, with their config's limits, and ``(book_id, reason)`` of the
    others: the manifest's own reason (S4), an unknown config, or a selector of another shape."""
    found = configs.select(*CONFIG_COLS, F.lit(True).alias("_known"))
    b = books.join(found, "config_id", "left")
    own = F.col("reject_reason") if "reject_reason" in books.columns else F.lit(None).cast("string")
    reason = F.coalesce(own, F.when(F.col("_known").isNull(), "config").when(F.col("selector").isNull(), "toc_selector"))
    b = b.withColumn("_reason", reason).drop("_known")
    return (b.filter(F.col("_reason").isNull()).drop("_reason"),
            b.filter(F.col("_reason").isNotNull()).select("book_id", F.col("_reason").alias("reason")))


def build_books(pages: DataFrame, books: DataFrame, configs: BookConfig | DataFrame,
                checkpoint: bool = True, read: PageReader | None = None) -> BookRun:
    """Sections and book lines for every book of the manifest.

    ``configs``: one config for all books, or a table of configs (``read_config``,
    ``parse_configs``, ``config_table``) that books name by ``config_id``.  Level by level, the
    links of the pages that the level reaches are found and joined as narrow tables; items are
    taken from the pages some book reaches, once per page, and sliced once per page and config.
    Each level is written as a table in the session's checkpoint folder, which cuts lineage
    (a lost executor replays one level, not the crawl) and keeps every plan small.  Books that
    can't be built are in ``rejects`` with the reason; the others are built all the same.
    ``read``: for pages that hold no ``html`` but what it is made of beside ``page_id`` and ``url``.
    """
    spark = pages.sparkSession
    if read is None:
        pages = pages.select("page_id", "url", "html")
    if isinstance(configs, BookConfig):
        configs = config_table(spark, {ONE_CONFIG: configs})
        books = books.withColumn("config_id", F.lit(ONE_CONFIG))
    if checkpoint:
        ensure_checkpoint_dir(spark)

    def cut(df: DataFrame) -> DataFrame:
        return _cut(df, checkpoint)

    cfg = cut(compiled_configs(configs))
    known = cfg.agg(F.max("max_depth").alias("depth"), F.max("include_images").alias("images"),
                    F.max("max_chapters").alias("cap"), F.collect_set("selector").alias("selectors")).first()
    good, rejects = gate(books, cfg)
    good, rejects = cut(good), cut(rejects)
    keys = cut(key_rows(pages))
    roots = cut(book_roots(good, wanted_keys(keys, cut(good.select(key_hash(url_norm_key(url_defrag(F.col("url"))))).distinct()))))
    limits = good.select("book_id", *CONFIG_COLS[1:])
    parents = roots.filter(F.col("root_page_id").isNotNull()).join(limits, "book_id").select(
        "book_id", *CONFIG_COLS, F.lit(0).alias("n1"), F.lit(0).alias("n2"), F.lit(0).alias("n3"),
        F.col("root_page_id").alias("page_id"), url_slug(F.col("url")).alias("slug"))
    levels, found = [], []
    for level in range(1, (known["depth"] or 1) + 1):                  # J5: 1 to 3 levels
        parents = parents.filter(F.col("max_depth") >= level)
        need = cut(parents.select("page_id").distinct())
        links = cut(chapter_links(reached_pages(pages, need, read), sorted(known["selectors"]) or None))
        aims = cut(links.filter(F.col("link_no") <= F.lit(known["cap"])).select(key_hash(F.col("norm_url"))).distinct())
        sec = cut(follow_links(parents, links, wanted_keys(keys, aims), level, child_only=level > 1))
        found.append(links)
        levels.append(sec)
        parents = sec.filter(F.col("page_id").isNotNull())
    sections, links = levels[0], found[0]
    for sec, more in zip(levels[1:], found[1:], strict=True):
        sections, links = sections.unionByName(sec), links.unionByName(more)
    sections = cut(section_numbers(sections))

    return BookRun(pages, good, cfg, links.dropDuplicates(["page_id", "selector", "link_no"]), roots, sections, rejects, checkpoint, read)
