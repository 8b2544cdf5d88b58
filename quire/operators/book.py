"""Book assembly (B1-B12), rendering (S7) and the run report (A1-A4).

A book is a set of sections keyed by ``(book_id, n1, n2, n3)`` (0 = none):
``n1 = -1`` is the table of contents, ``n1 = 0`` the introduction (root page), and
chapters are numbered from 1.  Every window here is partitioned by a *section* or a
chapter, never by a whole book, so a very large book still spreads over many tasks;
the partitions are bounded by the chapter cap (at most cap x cap sections per chapter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import bookmark_name, fill_placeholders, md_escape, md_line_start, md_target
from quire.functions.urls import url_spans
from quire.operators.html import RUN_TYPE
from quire.operators.site import BULLET
from quire.operators.slices import removed_flag

# Fixed values --------------------------------------------------------------
TOC_TITLE = "Table of Contents"
INTRO_TITLE = "Introduction"
PLACEHOLDER = {1: "[No content extracted for this chapter.]",
               2: "[No content extracted for this sub-chapter.]",
               3: "[No content extracted for this sub-sub-chapter.]"}
BIG_FONT_PT = 14
BIG_FONT_FROM_CHAPTER = 7  # chapters with 0-based index >= 6
# after the last sub-section of a chapter
END = 1 << 30

LINE_COLS = ["book_id", "n1", "n2", "n3", "rank", "idx", "kind", "style", "text", "markup", "img_url",
             "font_pt", "alt", "runs"]
# columns that only lines of a page have
PAGE_COLS = {"markup": "string", "alt": "string", "runs": RUN_TYPE}


def numbered_title(n1: Column, n2: Column, n3: Column, title: Column) -> Column:
    """B1: ``i. title`` / ``i.j title`` / ``i.j.k title``."""
    return (F.when(n2 == 0, F.concat(n1.cast("string"), F.lit(". "), title))
            .when(n3 == 0, F.concat(n1.cast("string"), F.lit("."), n2.cast("string"), F.lit(" "), title))
            .otherwise(F.concat(n1.cast("string"), F.lit("."), n2.cast("string"), F.lit("."),
                                n3.cast("string"), F.lit(" "), title)))


def section_numbers(sections: DataFrame) -> DataFrame:
    """Numbered heading text, bookmark id and name per section.

    The bookmark id is a depth-first counter from 1 over the book's sections.  It is
    built from per-chapter section counts (a prefix sum over at most ``cap`` chapter
    rows per book) plus a row number inside the chapter, so no window spans a book.
    L1 bookmark names use the chapter number, L2/L3 names use the counter.
    """
    per_ch = sections.groupBy("book_id", "n1").agg(F.count(F.lit(1)).alias("_cnt"))
    wb = Window.partitionBy("book_id").orderBy("n1").rowsBetween(Window.unboundedPreceding, -1)
    per_ch = per_ch.withColumn("_before", F.coalesce(F.sum("_cnt").over(wb), F.lit(0)))
    s = sections.join(per_ch.select("book_id", "n1", "_before"), ["book_id", "n1"])
    wc = Window.partitionBy("book_id", "n1").orderBy("n2", "n3")
    s = s.withColumn("bookmark_id", F.col("_before") + F.row_number().over(wc)).drop("_before")
    name_index = F.when(F.col("level") == 1, F.col("n1")).otherwise(F.col("bookmark_id"))
    return s.withColumn("number_title", numbered_title(F.col("n1"), F.col("n2"), F.col("n3"), F.col("title"))) \
            .withColumn("bookmark", bookmark_name(name_index, F.col("title")))


def _lines(df: DataFrame, **cols: Column) -> DataFrame:
    out = []
    for c in LINE_COLS:
        if c in cols:
            out.append(cols[c].alias(c))
        elif c in PAGE_COLS:
            out.append(F.lit(None).cast(PAGE_COLS[c]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out, "_book_title")


def book_lines(books: DataFrame, sections: DataFrame, content: DataFrame,
               roots: DataFrame) -> DataFrame:
    """``(book_id, n1, n2, n3, line_no, kind, style, text, markup, img_url, font_pt)``.

    ``markup`` is the line's runs as Markdown (B8: bold/italic kept per run).

    ``content``: sliced page items ``(page_id, config_id, idx, type, style, full_text, img_url)``;
    ``roots``: ``(book_id, config_id, root_page_id)``; ``books``: ``(book_id, title)``.
    Kinds: title, toc_field, heading, text, image, placeholder, break.  ``line_no``
    counts from 1 inside each section; page breaks follow the TOC, the introduction
    and each chapter (with all its sub-chapters).
    """
    lit_null_s = F.lit(None).cast("string")
    lit_null_i = F.lit(None).cast("int")
    b = books.select("book_id", F.col("title").alias("_book_title"))

    toc = (_lines(b, n1=F.lit(-1), n2=F.lit(0), n3=F.lit(0), rank=F.lit(0), idx=F.lit(0),
                  kind=F.lit("title"), style=F.lit("Title"), text=F.lit(TOC_TITLE),
                  img_url=lit_null_s, font_pt=lit_null_i)
           .unionByName(_lines(b, n1=F.lit(-1), n2=F.lit(0), n3=F.lit(0), rank=F.lit(1), idx=F.lit(0),
                               kind=F.lit("toc_field"), style=lit_null_s, text=F.lit('TOC \\o "1-3" \\h \\z \\u'),
                               img_url=lit_null_s, font_pt=lit_null_i))
           .unionByName(_lines(b, n1=F.lit(-1), n2=F.lit(END), n3=F.lit(END), rank=F.lit(0), idx=F.lit(0),
                               kind=F.lit("break"), style=lit_null_s, text=F.lit(""),
                               img_url=lit_null_s, font_pt=lit_null_i)))
    intro_head = _lines(b, n1=F.lit(0), n2=F.lit(0), n3=F.lit(0), rank=F.lit(0), idx=F.lit(0),
                        kind=F.lit("heading"), style=F.lit("Heading 1"), text=F.lit(INTRO_TITLE),
                        img_url=lit_null_s, font_pt=lit_null_i)
    intro_break = _lines(b, n1=F.lit(0), n2=F.lit(END), n3=F.lit(END), rank=F.lit(0), idx=F.lit(0),
                         kind=F.lit("break"), style=lit_null_s, text=F.lit(""),
                         img_url=lit_null_s, font_pt=lit_null_i)

    # One left join attaches every section to its page's content: matched rows are the
    # section's lines; an unmatched section (no page, or nothing extracted) becomes a
    # placeholder unless it has children (B6; level 3 needs no lines only).  The content
    # is read once; the child flag comes from the small sections table.
    c = content.select("page_id", "config_id", "idx", F.col("type").alias("_type"), F.col("style").alias("_style"),
                       "full_text", F.col("markup").alias("_markup"), "img_url", F.col("alt").alias("_alt"),
                       F.col("runs").alias("_runs"))
    child_of = sections.filter(F.col("level") >= 2).select(
        "book_id", "n1",
        F.when(F.col("level") == 3, F.col("n2")).otherwise(F.lit(0)).alias("n2"),
        F.lit(0).alias("n3")).distinct().withColumn("_has_children", F.lit(True))
    secs = sections.select("book_id", "config_id", "n1", "n2", "n3", "page_id", "level").join(
        child_of, ["book_id", "n1", "n2", "n3"], "left")
    intro_sec = roots.select("book_id", "config_id", F.col("root_page_id").alias("page_id"),
                             F.lit(0).alias("n1"), F.lit(0).alias("n2"), F.lit(0).alias("n3"),
                             F.lit(0).alias("level"), F.lit(True).alias("_has_children"))
    attached = intro_sec.unionByName(secs).join(b, "book_id").join(c, ["page_id", "config_id"], "left")
    level = F.col("level")
    is_line = F.col("idx").isNotNull()
    is_ph = ~is_line & (level > 0) & ~F.coalesce(F.col("_has_children"), F.lit(False))
    ph_text = (F.when(level == 1, F.lit(PLACEHOLDER[1])).when(level == 2, F.lit(PLACEHOLDER[2]))
               .otherwise(F.lit(PLACEHOLDER[3])))
    body = _lines(attached.filter(is_line | is_ph),
                  rank=F.when(is_line, F.lit(1)).otherwise(F.lit(2)),
                  idx=F.coalesce(F.col("idx"), F.lit(0)),
                  kind=F.when(is_line, F.col("_type")).otherwise(F.lit("placeholder")),
                  style=F.when(is_line, F.col("_style")).otherwise(F.lit("Normal")),
                  text=F.when(is_line, F.when(F.col("_type") == "image", lit_null_s)
                              .otherwise(F.col("full_text"))).otherwise(ph_text),
                  markup=F.when(is_line, F.col("_markup")), alt=F.col("_alt"), runs=F.col("_runs"),
                  img_url=F.col("img_url"),
                  font_pt=F.when(is_line & (F.col("n1") >= BIG_FONT_FROM_CHAPTER),
                                 F.lit(BIG_FONT_PT)).otherwise(lit_null_i))

    titled = sections.join(b, "book_id")
    heads = _lines(titled, rank=F.lit(0), idx=F.lit(0), kind=F.lit("heading"),
                   style=F.concat(F.lit("Heading "), level.cast("string")),
                   text=numbered_title(F.col("n1"), F.col("n2"), F.col("n3"), F.col("title")),
                   img_url=lit_null_s, font_pt=lit_null_i)
    breaks = _lines(titled.filter(level == 1), n2=F.lit(END), n3=F.lit(END), rank=F.lit(0),
                    idx=F.lit(0), kind=F.lit("break"), style=lit_null_s, text=F.lit(""),
                    img_url=lit_null_s, font_pt=lit_null_i)

    allrows = (toc.unionByName(intro_head).unionByName(intro_break).unionByName(body)
               .unionByName(heads).unionByName(breaks))
    # Placeholders in every text line take the book title, which came with the section
    allrows = allrows.withColumn(
        "runs", F.transform("runs", lambda r: r.withField("text", fill_placeholders(r["text"], F.col("_book_title"))))).withColumn(
        "text", fill_placeholders(F.col("text"), F.col("_book_title"))).withColumn(
        "markup", fill_placeholders(F.col("markup"), F.col("_book_title"))).drop("_book_title")
    # dealt by sub-chapter, which holds its sections whole: what renders sub-chapters shuffles nothing again
    allrows = allrows.repartition("book_id", "n1", "n2")
    w = Window.partitionBy("book_id", "n1", "n2", "n3").orderBy("rank", "idx")
    return allrows.select("book_id", "n1", "n2", "n3", F.row_number().over(w).alias("line_no"),
                          "kind", "style", "text", "markup", "img_url", "font_pt", "alt", "runs")


def line_pieces(lines: DataFrame) -> DataFrame:
    """Text lines as the pieces a writer sets one by one, ``(book_id, n1, n2, n3, line_no,
    piece_no, text, bold, italic, is_url)``.

    A run follows the one before it after a plain space; inside a run every URL is a piece of its
    own with the run's formats.  A bullet that fell back to another style (J7, column
    ``bullet_indent``) starts with its sign, set as the first run is.  Lines without runs (the
    source line) are one plain run.
    """
    plain = F.array(F.struct(F.lit(0).alias("pos"), F.col("text").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    sign = F.lit("")
    if "bullet_indent" in lines.columns:
        sign = F.when(F.col("bullet_indent") & F.col("_runs"), F.lit(BULLET)).otherwise(F.lit(""))

    def piece(text: Column, bold: Column, italic: Column, is_url: Column) -> Column:
        return F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), is_url.alias("is_url"))

    def pieces(r: Column, i: Column) -> Column:
        text = F.when(i == 0, F.concat(sign, r["text"])).otherwise(r["text"])
        own = F.transform(url_spans(text), lambda s: piece(s["text"], r["bold"], r["italic"], s["is_url"]))
        space = F.array(piece(F.lit(" "), F.lit(False), F.lit(False), F.lit(False)))
        return F.when(i > 0, F.concat(space, own)).otherwise(own)

    text = lines.filter(F.col("kind") == "text").withColumn("_runs", F.col("runs").isNotNull()).withColumn(
        "runs", F.coalesce("runs", plain))
    return text.select("book_id", "n1", "n2", "n3", "line_no", F.posexplode(F.flatten(F.transform("runs", pieces)))
                       .alias("piece_no", "p")).select("book_id", "n1", "n2", "n3", "line_no", "piece_no", "p.*")


def toc_entries(lines: DataFrame) -> DataFrame:
    """Headings the TOC field lists (levels 1-3): Introduction, chapter headings and
    content items styled ``Heading 3`` (content h1-h3 reach the TOC)."""
    h = lines.filter((F.col("kind") == "heading") | (F.col("style") == "Heading 3"))
    lvl = F.when(F.col("style") == "Heading 1", 1).when(F.col("style") == "Heading 2", 2).otherwise(3)
    return h.select("book_id", "n1", "n2", "n3", "line_no", lvl.alias("toc_level"), "text")


def header_footer(books: DataFrame, default_header: str, default_footer: str) -> DataFrame:
    """Header text (title or a default) and footer text (source URL or default)."""
    return books.select(
        "book_id",
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(default_header)).alias("header"),
        F.coalesce(F.when(F.col("url") != "", F.col("url")), F.lit(default_footer)).alias("footer"))


def line_markdown(kind: Column, style: Column, text: Column, img_url: Column,
                  markup: Column | None = None, alt: Column | None = None) -> Column:
    """One book line as Markdown (the text sink of S7); runs keep bold/italic (B8), text is
    escaped, an image keeps its alt text."""
    text = md_escape(text)
    if markup is not None:
        text = F.coalesce(markup, text)
    line = md_line_start(text)
    label = md_escape(F.coalesce(alt, F.lit("image"))) if alt is not None else F.lit("image")
    return (F.when(kind == "title", F.concat(F.lit("# "), text))
            .when(kind == "toc_field", F.lit("[TOC]"))
            .when(kind == "break", F.lit("---"))
            .when(kind == "image", F.concat(F.lit("!["), label, F.lit("]("), md_target(img_url), F.lit(")")))
            .when(style.startswith("Heading "),
                  F.concat(F.repeat(F.lit("#"), F.substring(style, 9, 2).cast("int") + 1), F.lit(" "), text))
            .when(style == "List Bullet", F.concat(F.lit("- "), line))
            .when(style == "List Number", F.concat(F.lit("1. "), line))
            .otherwise(line))


def _alt(lines: DataFrame) -> Column | None:
    return F.col("alt") if "alt" in lines.columns else None


def render_chapters(lines: DataFrame) -> DataFrame:
    """S7 (checkable form): one Markdown text per ``(book_id, n1, n2)`` — a chapter's
    own page, or one sub-chapter with its sub-sub-chapters — lines in order.  Each
    text holds at most one page plus ``cap`` child pages; never a whole book or a whole
    chapter (which can reach cap x cap pages).  ``write_books`` is the scalable sink."""
    md = lines.select("book_id", "n1", "n2", "n3", "line_no",
                      line_markdown(F.col("kind"), F.col("style"), F.col("text"), F.col("img_url"),
                                    F.col("markup"), _alt(lines)).alias("md"))
    return md.groupBy("book_id", "n1", "n2").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n3", "line_no", "md"))), lambda x: x["md"]), "\n")
        .alias("markdown"))


def write_books(lines: DataFrame, path: str) -> None:
    """S6/S7 sink: Markdown lines partitioned by book; a rerun replaces only the books
    it contains (dynamic partition overwrite), never other books' output (D8)."""
    md = lines.select("book_id", "n1", "n2", "n3", "line_no",
                      line_markdown(F.col("kind"), F.col("style"), F.col("text"), F.col("img_url"),
                                    F.col("markup"), _alt(lines)).alias("value"))
    (md.repartitionByRange("book_id", "n1", "n2", "n3").sortWithinPartitions("book_id", "n1", "n2", "n3", "line_no")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("book_id").parquet(path))


# ------------------------------------------------------------------ report (A1-A4)
def page_report(bounds: DataFrame, remove=None, by=("page_id",)) -> DataFrame:
    """A1: per page: items parsed, in the slice, removed from it by the removal list and
    kept, and whether a start and a stop marker were found (``no_start``, ``no_stop``: not)."""
    inside = F.coalesce((F.col("idx") >= F.col("slice_start")) & (
        F.col("slice_stop").isNull() | (F.col("idx") < F.col("slice_stop"))), F.lit(False))
    gone = inside & F.col("_removed")
    marked = bounds if "_removed" in bounds.columns else removed_flag(bounds, remove)
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items_parsed"), F.count_if(inside).alias("items_sliced"),
        F.count_if(gone).alias("items_removed"), F.count_if(inside & ~F.col("_removed")).alias("items_kept"),
        F.max(F.col("slice_start").isNotNull().cast("int")).alias("has_start"),
        F.max(F.col("slice_stop").isNotNull().cast("int")).alias("has_stop"),
        F.max(F.col("slice_start").isNull().cast("int")).alias("no_start"),
        F.max((F.col("slice_start").isNotNull() & F.col("slice_stop").isNull()).cast("int")).alias("no_stop"))


def link_report(links_uncapped: DataFrame, max_chapters: int) -> DataFrame:
    """A2: links found per page and whether the cap cut them."""
    return links_uncapped.groupBy("page_id").agg(F.count(F.lit(1)).alias("links_found")).select(
        "page_id", "links_found",
        F.least(F.col("links_found"), F.greatest(F.lit(1), F.lit(max_chapters))).alias("links_kept"),
        (F.col("links_found") > F.greatest(F.lit(1), F.lit(max_chapters))).alias("cap_reached"))


def book_report(sections: DataFrame) -> DataFrame:
    """A3: sections and missing pages per book and level, with per-book and grand
    totals (``rollup``: level NULL = all levels, book_id NULL = all books)."""
    return sections.rollup("book_id", "level").agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if(F.col("status") == "missing").alias("missing"))


def run_report(sections: DataFrame, marked: DataFrame, links: DataFrame, lines: DataFrame, images: DataFrame) -> DataFrame:
    """A3 in full, per book and level with totals of books and of all (``rollup``): sections, pages
    that were not captured, pages without a start or a stop marker, items kept and removed, links
    that the cap cut off, images without bytes.

    Taken from what the job wrote (``marked`` items, ``links``), not from the html again.
    ``links``: uncapped; ``lines``: book lines; ``images``: ``(url)`` of images with bytes."""
    pages = page_report(marked, by=("page_id", "config_id")).select("page_id", "config_id", "no_start", "no_stop", "items_kept", "items_removed")
    found = links.groupBy("page_id", "selector").agg(F.max("link_no").alias("_links"))
    s = (sections.select("book_id", "level", "n1", "n2", "n3", "page_id", "config_id", "selector", "max_chapters", "max_depth", "status")
         .join(pages, ["page_id", "config_id"], "left").join(found, ["page_id", "selector"], "left"))
    cut = F.when(F.col("level") < F.col("max_depth"), F.greatest(F.lit(0), F.coalesce("_links", F.lit(0)) - F.col("max_chapters")))
    counts = s.select("book_id", "level", F.lit(1).alias("sections"), (F.col("status") == "missing").cast("int").alias("missing"),
                      "no_start", "no_stop", F.col("items_kept").alias("kept"), F.col("items_removed").alias("removed"),
                      cut.alias("links_cut"), F.lit(0).alias("images_failed"))
    level = F.when(F.col("n2") == 0, 1).when(F.col("n3") == 0, 2).otherwise(3)
    failed = (lines.filter((F.col("kind") == "image") & (F.col("n1") > 0)).select("book_id", level.alias("level"), F.col("img_url").alias("url"))
              .join(images.select("url").distinct(), "url", "left_anti")
              .select("book_id", "level", *[F.lit(0).alias(c) for c in counts.columns[2:-1]], F.lit(1).alias("images_failed")))
    return counts.unionByName(failed).rollup("book_id", "level").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts.columns[2:]])


def toc_preview(sections: DataFrame, n: int = 10) -> DataFrame:
    """A4: first ``n`` chapters per book plus how many more there are."""
    l1 = sections.filter(F.col("level") == 1)
    w = Window.partitionBy("book_id").orderBy("n1")
    wc = Window.partitionBy("book_id")
    return l1.select("book_id", "n1", "title", F.row_number().over(w).alias("_rn"),
                     F.count(F.lit(1)).over(wc).alias("_total")).filter(F.col("_rn") <= n).select(
        "book_id", "n1", "title", F.greatest(F.col("_total") - F.lit(n), F.lit(0)).alias("more"))

