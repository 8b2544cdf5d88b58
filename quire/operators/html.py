"""HTML -> ordered content items.

A page is cut into tokens (tags, text) with one regex, all inside its row.  Which element a
token lies in — stripped element, content root, block, ``<br>`` part, bold, anchor — is answered
by one fold over the page's tag codes (``quire.operators.tree``, an Arrow function that sees
tag names only); everything else is built-in Spark.  The fold returns the wanted tokens, so
navigation, scripts and markup never leave the scan's task: what is exploded and shuffled is
the text of blocks and the image tags.

Physical shape: scan -> tokens -> places -> explode, no Exchange; then one Exchange of the kept
text by ``page_id``, which all item windows and aggregates reuse.

Deliberate deviations from a full HTML parser are listed in README.md (D1-D6).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import tree, walk
from quire.session import bounded_batches

# The fold and the walk go to the workers with the plan: they need not have this package.
cloudpickle.register_pickle_by_value(tree)
cloudpickle.register_pickle_by_value(walk)

# Fixed values --------------------------------------------------------------
BLOCK_TAGS = ["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "pre"]
HEADING_STYLE = {"h1": "Heading 3", "h2": "Heading 3", "h3": "Heading 3",
                 "h4": "Heading 4", "h5": "Heading 4", "h6": "Heading 4"}
STRIP_TAGS = ["script", "style", "noscript", "nav", "footer", "header",
              "aside", "form", "button", "iframe"]
# removed whole, with their text, before tokens are cut
RAW_TEXT_TAGS = ["script", "style", "noscript"]
ROOT_CLASS_RE = r"(?i)(content|entry|post|article|body)"
# Tokenizer: raw-text elements whole (to end of input when unclosed), comments,
# tags, declarations, text runs, and a lone '<' as text.  Same result in Java and RE2.
# The leading '<' is factored out so the matcher fails fast everywhere else.
RAW_TEXT_RE = (r"(?s)<(?:(?i:script)(?:\s[^>]*)?>.*?(?:</(?i:script)\s*>|\z)"
               r"|(?i:style)(?:\s[^>]*)?>.*?(?:</(?i:style)\s*>|\z)"
               r"|(?i:noscript)(?:\s[^>]*)?>.*?(?:</(?i:noscript)\s*>|\z)"
               r"|!--.*?(?:-->|\z))")
# A ">" inside a quoted attribute value does not end the tag; a quote counts only after
# "=".  The repeats are possessive: they loop where backtracking repeats would recurse.
TOKEN_RE = (r"(?s)<(?:/?[A-Za-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>|[!?][^>]*>)?|[^<]+")
# A raw-text element or comment is replaced by an empty comment: it still separates
# the text on its two sides (as a parser's separate text nodes would), but its
# content never reaches the shuffle.
SEPARATOR = "<!---->"
TAG_NAME_RE = r"^</?([A-Za-z][^ \t\n\r\f/>]*)"


def _attr(tk: Column, name: str, decode: bool = True) -> Column:
    """Value of attribute ``name`` in a start tag ('' when absent), entity-decoded."""
    pat = r"(?i)\s" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    raw = F.concat(F.regexp_extract(tk, pat, 1), F.regexp_extract(tk, pat, 2),
                   F.regexp_extract(tk, pat, 3))
    return T.decode_entities(raw) if decode else raw


def _has_attr(tk: Column, name: str) -> Column:
    return tk.rlike(r"(?i)\s" + name + r"(\s*=|[\s/>])")


# ---------------------------------------------------------------- H1 tokens
def _kind(tk: Column) -> Column:
    """TOKEN_RE fixes the shapes: a token starting "</" is an end tag, "<!" / "<?" a
    declaration, any other "<"-token longer than one char a start tag; the rest (including
    a lone "<") is text.  Prefix tests instead of a regex per token."""
    return (F.when(tk.startswith("</"), "close")
            .when(tk.startswith("<!") | tk.startswith("<?"), "other")
            .when(tk.startswith("<") & (F.length(tk) > 1), "open")
            .otherwise("text"))


def _token_arrays(pages: DataFrame) -> DataFrame:
    """``(page_id, url, tks)``: a page's tokens in one row; raw-text elements and comments are
    cut out first."""
    html = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), RAW_TEXT_RE, SEPARATOR)
    return pages.select("page_id", "url", F.regexp_extract_all(html, F.lit(TOKEN_RE), 0).alias("tks"))


def _token_rows(rows: DataFrame) -> DataFrame:
    """Adds ``kind``, ``tag`` and, on the tags that resolve links, ``base_url``; drops declarations."""
    kind = _kind(F.col("tk"))
    tag = F.lower(F.regexp_extract("tk", TAG_NAME_RE, 1))
    rows = rows.select("page_id", "pos", "tk", kind.alias("kind"), F.when(kind != "text", tag).alias("tag"), "url")
    return rows.filter(F.col("kind") != "other").select(
        "page_id", "pos", "tk", "kind", "tag",
        F.when((F.col("kind") == "open") & F.col("tag").isin("a", "img"), F.col("url")).alias("base_url"))


def html_tokens(pages: DataFrame) -> DataFrame:
    """H1: ``(page_id, pos, tk, kind, tag, base_url)``; kinds open/close/text.

    Raw-text elements and comments are dropped; ``base_url`` is the page URL on
    ``a``/``img`` start tags only (the tokens that resolve links), NULL elsewhere.
    """
    return _token_rows(_token_arrays(pages).select("page_id", "url", F.posexplode("tks").alias("pos", "tk")))


# ---------------------------------------------------------------- H2-H7 places
def _code(tk: Column) -> Column:
    """A tag's name as the fold reads it (``tree.parse_code``); empty for texts and declarations."""
    name = F.lower(F.regexp_extract(tk, TAG_NAME_RE, 1))
    marked = (name == "div") & _attr(tk, "class", decode=False).rlike(ROOT_CLASS_RE)
    return (F.when(_kind(tk) == "close", F.concat(F.lit("/"), name))
            .when(_kind(tk) == "open", F.concat(name, F.when(tk.endswith("/>"), F.lit("/")).otherwise(F.lit("")),
                                                F.when(marked, F.lit("*")).otherwise(F.lit(""))))
            .otherwise(F.lit("")))


def placed_tokens(pages: DataFrame, want: str, strip_tags: list[str] | None = None, root: str = "auto",
                  parents: list[str] | None = None) -> DataFrame:
    """H2-H7: the wanted tokens with their places, ``(page_id, url, pos, own, part, bold, italic,
    tag, up, tk)``; ``tree.places`` says what ``want`` and the columns mean.  No Exchange."""
    if root not in ("auto", "body"):
        raise ValueError(f"unknown root mode {root!r}")
    bounded_batches(pages.sparkSession)
    strip, around = frozenset(STRIP_TAGS if strip_tags is None else strip_tags), frozenset(parents or ())

    fold = tree.place_batch

    @F.arrow_udf(tree.PLACE)
    def place(codes: pa.Array) -> pa.Array:
        return fold(codes, strip, root, want, around)

    rows = _token_arrays(pages).select("page_id", "url", "tks", place(F.transform("tks", _code)).alias("places"))
    wanted = F.transform("places", lambda p: F.struct(
        *[p[c].alias(c) for c in ("pos", "own", "part", "bold", "italic", "tag", "up")], F.get("tks", p["pos"]).alias("tk")))
    return rows.select("page_id", "url", F.inline(wanted))


def strip_noise(pages: DataFrame, strip_tags: list[str] | None = None) -> DataFrame:
    """H2: the tokens outside stripped elements, with none of the elements' own tags."""
    return _token_rows(placed_tokens(pages, "kept", strip_tags))


def content_root(pages: DataFrame, root: str = "auto", strip_tags: list[str] | None = None) -> DataFrame:
    """H3: of these the tokens inside the content root.

    ``auto``: first ``article``, else first ``main``, else first ``div`` whose class
    matches ``(content|entry|post|article|body)``, else ``body``, else the whole page
    (priority order, not document order).  ``body``: first ``body`` or the whole page.
    """
    return _token_rows(placed_tokens(pages, "root", strip_tags, root))


def _run_markup(r: Column) -> Column:
    """One run as Markdown, its own characters escaped: ``***both***``, ``**bold**``, ``*italic*`` or plain."""
    t, b, i = T.md_escape(r["text"]), r["bold"], r["italic"]
    return (F.when(b & i, F.concat(F.lit("***"), t, F.lit("***")))
            .when(b, F.concat(F.lit("**"), t, F.lit("**")))
            .when(i, F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t))


def _style(tag: Column, up: Column) -> Column:
    """Heading map, list item by its parent, else Normal."""
    style = F.lit("Normal")
    for h, name in HEADING_STYLE.items():
        style = F.when(tag == h, F.lit(name)).otherwise(style)
    return F.when(tag == "li", F.when(F.coalesce(up == "ol", F.lit(False)), F.lit("List Number")).otherwise(
        F.lit("List Bullet"))).otherwise(style)


# ---------------------------------------------------------------- pages of their own id
MOST_SHARED = 1000


def apart(pages: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The pages whose id no other page has, and the others, which have to meet by id.  A job finds the ids of several
    pages; above ``MOST_SHARED`` of them (and where ids are null) all pages meet: none is told to be alone."""
    ids = pages.select("page_id").filter(F.col("page_id").isNotNull()).groupBy("page_id").count().filter(F.col("count") > 1)
    shared = [r.page_id for r in ids.select("page_id").limit(MOST_SHARED + 1).collect()]
    if len(shared) > MOST_SHARED:
        return None, pages
    meet = F.col("page_id").isNull()
    if shared:
        meet = meet | F.col("page_id").isin(shared)
    return pages.filter(~meet), pages.filter(meet)


def walked(pages: DataFrame, rows: walk.Batches, columns: str) -> DataFrame:
    """``rows`` of every page, made in the scan's tasks: ``page_id`` and ``columns``."""
    bounded_batches(pages.sparkSession)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {columns}"
    return pages.select("page_id", "url", F.make_valid_utf8("html").alias("html")).mapInArrow(rows, schema)


# ---------------------------------------------------------------- H15 items
RUN_TYPE = "array<struct<pos:int,text:string,bold:boolean,italic:boolean>>"


ITEM = ["page_id", "idx", "type", "style", "runs", "full_text", "markup", "img_url", "alt"]
FLAT_ITEM = ["page_id", "idx", "type", "style", "full_text", "img_url", "alt", "n_runs", "bold_text"]


def flat_items(items: DataFrame) -> DataFrame:
    """Items with the number of their runs and the bold texts instead of the runs."""
    bold = F.array_join(F.transform(F.filter("runs", lambda r: r["bold"]), lambda r: r["text"]), "|")
    return items.select(*FLAT_ITEM[:7], F.coalesce(F.size("runs"), F.lit(0)).alias("n_runs"),
                        F.coalesce(bold, F.lit("")).alias("bold_text"))


def items_by_page(pages: DataFrame, include_images: bool = False, root: str = "auto", strip_tags: list[str] | None = None,
               dedup: bool = True, flat: bool = False, texts: bool = True) -> DataFrame:
    """``page_items`` of very many pages: those whose id no other page has are walked one by one (``quire.operators.walk``)
    and shuffle nothing, the others meet by id as there.  ``flat``: as ``flat_items``; without ``texts``: images only."""
    alone, meet = apart(pages)
    items = page_items(meet, include_images, root, strip_tags, dedup)
    items = flat_items(items) if flat else items
    if not texts:
        items = items.filter("type = 'image'")
    if alone is None:
        return items
    strip = frozenset(STRIP_TAGS if strip_tags is None else strip_tags)
    rows = walked(alone, walk.item_rows(strip, root, include_images, dedup, not flat, texts),
                  "idx int, style string, full_text string, img_url string, src string, base_url string, alt string, "
                  + ("n_runs int, bold_text string" if flat else f"runs {RUN_TYPE}"))
    is_img = F.col("alt").isNotNull()
    rows = U.with_resolved_url(rows, "base_url", "src", "_url")
    rows = rows.withColumn("img_url", F.coalesce("img_url", "_url")).withColumn("type", F.when(is_img, F.lit("image")).otherwise(F.lit("text")))
    if not flat:
        rows = rows.withColumn("markup", F.when(~is_img, F.array_join(F.transform("runs", _run_markup), " ")))
    return rows.select(*items.columns).unionByName(items)


def page_items(pages: DataFrame, include_images: bool = False, root: str = "auto",
               strip_tags: list[str] | None = None, dedup: bool = True) -> DataFrame:
    """``items(page_id, idx, type, style, runs, full_text, markup, img_url, alt)``.

    Text items: one per block part with at least one non-blank run; a block with a block as a
    child yields nothing itself (H5), a ``br`` right under a block starts a part (H6); runs
    carry bold/italic from tags inside the block only; ``full_text`` is the runs joined with
    a space.  A text item is kept only at the first occurrence of its ``full_text`` in
    the page (H12).  Image items (H13) stand where their tag stands, behind the text of the
    block or part they lie in (H14).
    """
    rows = placed_tokens(pages, "items", strip_tags, root)
    is_img = F.col("tag") == "img"
    rows = rows.filter((is_img & F.lit(include_images)) | (~is_img & (_kind(F.col("tk")) == "text")))
    rows = rows.select("page_id", "pos", "part", "bold", "italic", "tag", "up", "tk",
                       F.when(is_img, F.col("url")).alias("base_url")).repartition("page_id")
    rows = rows.withColumn("_text", F.when(~is_img, T.collapse_ws(T.decode_entities(F.col("tk")))))
    run = F.when(F.col("_text") != "", F.struct("pos", F.col("_text").alias("text"), "bold", "italic"))
    items = rows.groupBy("page_id", "part").agg(
        F.array_sort(F.collect_list(run)).alias("runs"), F.first("tag").alias("tag"), F.first("up").alias("up"),
        F.first(F.when(is_img, F.col("tk")), ignorenulls=True).alias("_tk"),
        F.first("base_url", ignorenulls=True).alias("base_url"))
    items = items.select(
        "*", T.py_strip(T.decode_entities(_attr(F.col("_tk"), "src", decode=False))).alias("_src"),
        T.py_strip(T.decode_entities(_attr(F.col("_tk"), "alt", decode=False))).alias("_alt"))
    items = items.filter(F.when(is_img, F.col("_src").rlike(r"(?s)^(?!data:).")).otherwise(F.size("runs") > 0))
    items = U.with_resolved_url(items, "base_url", "_src", "img_url")
    items = items.select(
        "page_id", "part", F.when(is_img, F.lit("image")).otherwise(F.lit("text")).alias("type"),
        F.when(~is_img, _style(F.col("tag"), F.col("up"))).alias("style"),
        F.when(~is_img, F.col("runs")).alias("runs"),
        F.when(is_img, F.lit("")).otherwise(F.array_join(F.transform("runs", lambda r: r["text"]), " ")).alias("full_text"),
        F.when(~is_img, F.array_join(F.transform("runs", _run_markup), " ")).alias("markup"),
        F.when(is_img, F.col("img_url")).alias("img_url"),
        F.when(is_img, F.when(F.col("_alt") != "", F.col("_alt")).otherwise(F.lit("Image"))).alias("alt"))
    if dedup:
        wd = Window.partitionBy("page_id", "type", "full_text").orderBy("part")
        items = items.withColumn("_first", F.row_number().over(wd)).filter(
            (F.col("type") != "text") | (F.col("_first") == 1)).drop("_first")
    wi = Window.partitionBy("page_id").orderBy("part")
    return items.select(
        "page_id", (F.row_number().over(wi) - 1).alias("idx"), "type", "style", "runs",
        "full_text", "markup", "img_url", "alt")
