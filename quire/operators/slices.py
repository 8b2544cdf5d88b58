"""Marker slicing on ordered item tables (M1-M8).

Items are rows ``(page_id, idx, type, style, full_text, ...)`` with ``idx`` dense from 0
in document order.  Markers are a Python list (one config for the run: compiled into
the predicate) or an array column on each item row (per-row configs from a broadcast
config join), so no row-wise theta join is ever planned.

All windows partition by ``page_id``: items that come out of ``page_items`` are
already partitioned that way, so slicing adds no Exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import matches_any
from quire.session import written

SOURCE_PREFIX = "Content Source - "


def str_array(values: Iterable[str] | None) -> Column:
    """Literal array column (for markers that vary per row, pass a column instead)."""
    vals = list(values or [])
    if not vals:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in vals])


def _page_window(by=("page_id",)) -> Window:
    return (Window.partitionBy(*by).orderBy("idx")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def slice_bounds(items: DataFrame, start_markers, stop_markers, by=("page_id",)) -> DataFrame:
    """M2/M3: add ``slice_start`` and ``slice_stop`` (both per page, NULL = none).

    start = one item before the first start-marker hit.  stop = first hit strictly
    after ``start`` (so the item right after ``start`` — usually the start line — is
    tested too).  The NULL guard matters: ``greatest(0, NULL)`` is 0, which would
    slice a page with no start marker from its first item.  ``by`` names what is sliced:
    a page, or a page under one of several configs.
    """
    w = _page_window(by)
    txt = F.coalesce(F.col("full_text"), F.lit(""))
    first_hit = F.min(F.when(matches_any(txt, start_markers), F.col("idx"))).over(w)
    t = items.withColumn("_f", first_hit).withColumn(
        "slice_start", F.when(F.col("_f").isNotNull(), F.greatest(F.lit(0), F.col("_f") - 1)))
    stop_hit = matches_any(txt, stop_markers) & (F.col("idx") > F.col("slice_start"))
    return t.withColumn("slice_stop", F.min(F.when(stop_hit, F.col("idx"))).over(w)).drop("_f")


def _in_slice() -> Column:
    return F.coalesce((F.col("idx") >= F.col("slice_start")) & (
        F.col("slice_stop").isNull() | (F.col("idx") < F.col("slice_stop"))), F.lit(False))


def slice_items(items: DataFrame, start_markers, stop_markers) -> DataFrame:
    """M2-M4: keep ``start <= idx < stop``; pages without a start marker keep nothing."""
    return slice_bounds(items, start_markers, stop_markers).filter(_in_slice())


def removed_flag(items: DataFrame, remove) -> DataFrame:
    """M5 as a flag ``_removed``: ``full_text`` equals an entry, ignoring case.

    ``remove`` is a Python list (an ``IN`` test), an array column (``exists``), or a
    DataFrame with a ``text`` column, of any size: the distinct lines of the items (a line that
    stands on very many pages is one row by then) are reduced to those on the list and written;
    the items are joined with these few, whose size the planner knows.
    """
    low = F.lower(F.coalesce(F.col("full_text"), F.lit("")))
    if remove is None:
        return items.withColumn("_removed", F.lit(False))
    if isinstance(remove, DataFrame):
        keys = remove.select(F.lower(F.col("text")).alias("_rk")).distinct()
        hits = written(items.select(low.alias("_rk")).distinct().join(keys, "_rk", "left_semi"))
        return (items.withColumn("_rk", low).join(hits.withColumn("_hit", F.lit(True)), "_rk", "left")
                .withColumn("_removed", F.coalesce(F.col("_hit"), F.lit(False))).drop("_rk", "_hit"))
    if isinstance(remove, (list, tuple)):
        return items.withColumn("_removed", low.isin(*[r.lower() for r in remove]) if remove else F.lit(False))
    hit = F.exists(F.coalesce(remove, F.array().cast("array<string>")), lambda r: F.lower(r) == low)
    return items.withColumn("_removed", F.coalesce(hit, F.lit(False)))


def remove_text(items: DataFrame, remove) -> DataFrame:
    """M5: drop items whose whole ``full_text`` equals an entry, ignoring case."""
    return removed_flag(items, remove).filter(~F.col("_removed")).drop("_removed")


def marked_items(items: DataFrame, start_markers, stop_markers, remove=None, by=("page_id",)) -> DataFrame:
    """Every item with ``slice_start``, ``slice_stop`` and ``_removed``: what M4-M7 and the reports
    are taken from."""
    return removed_flag(slice_bounds(items, start_markers, stop_markers, by), remove)


def extract_content(items: DataFrame, urls: DataFrame | None, start_markers, stop_markers,
                    remove=None, renumber: bool = True, by=("page_id",)) -> DataFrame:
    """M7: slice, remove, append ``Content Source - {url}``, renumber ``idx`` from 0.

    One pass over the items: pages without a start marker drop out, the page URL is
    joined onto the remaining rows (the items are already partitioned by ``page_id``,
    so only the small URL side moves), and the first row of each slice emits the source
    line next to itself, so a page whose slice is empty after removal still gets it.
    ``urls``: ``(page_id, url)``, or the name of a column that holds it; NULL or empty URL -> no
    source line.  Columns of ``by`` are kept on the source line.
    """
    return content_of(marked_items(items, start_markers, stop_markers, remove, by), urls, renumber, by)


def content_of(marked: DataFrame, urls: DataFrame | str | None, renumber: bool = True, by=("page_id",)) -> DataFrame:
    """M4-M7 on marked items (``extract_content``)."""
    t = marked.filter(F.col("slice_start").isNotNull())
    items = marked.drop("slice_start", "slice_stop", "_removed")
    if isinstance(urls, str):
        t = t.withColumn("_url", F.col(urls))
    elif urls is not None:
        t = t.join(urls.select("page_id", F.col("url").alias("_url")), "page_id", "left")
    else:
        t = t.withColumn("_url", F.lit(None).cast("string"))
    cols = [c for c in items.columns]
    keep = _in_slice() & ~F.col("_removed")
    item = F.struct(*[F.col(c) for c in cols])
    src_vals = {**{c: F.col(c) for c in by}, "idx": F.lit(1 << 30), "type": F.lit("text"),
                "style": F.lit("Normal"),
                "full_text": F.concat(F.lit(SOURCE_PREFIX), F.col("_url"))}
    src = F.struct(*[(src_vals[c] if c in src_vals else F.lit(None).cast(items.schema[c].dataType)).alias(c)
                     for c in cols])
    has_src = (F.col("idx") == F.col("slice_start")) & F.col("_url").isNotNull() & (F.col("_url") != "")
    out = t.select(F.explode(F.array_compact(F.array(
        F.when(keep, item), F.when(has_src, src)))).alias("_r")).select("_r.*")
    if renumber:
        w = Window.partitionBy(*by).orderBy("idx")
        out = out.withColumn("idx", F.row_number().over(w) - 1)
    return out
