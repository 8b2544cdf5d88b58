"""URL Column expressions U1-U9 (regex-based, never ``java.net.URI``).

``parse_url`` follows strict URI rules and returns NULL for URLs that browsers and
Python accept (spaces, ``|``, ``{}``), so the parts are cut with plain regexes that
behave the same in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import PY_WS_CLASS

# Fixed values --------------------------------------------------------------
ALLOWED_SCHEMES = ["http", "https"]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# What the book writer styles as a link.
URL_SPAN_RE = r"https?://[^" + PY_WS_CLASS[1:-1] + r"]+|www\.[^" + PY_WS_CLASS[1:-1] + r"]+"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME_RE, 1))


def netloc(u: Column) -> Column:
    """Authority part (userinfo, host and port); '' when there is none."""
    return F.regexp_extract(u, NETLOC_RE, 1)


def host(u: Column) -> Column:
    """Lower-cased host without userinfo, port or IPv6 brackets."""
    n = F.regexp_replace(netloc(u), r"^.*@", "")
    bracketed = F.regexp_extract(n, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(n, r":[^:]*$", "")
    return F.lower(F.when(n.startswith("["), bracketed).otherwise(plain))


def url_reject_reason(u: Column) -> Column:
    """NULL when valid, otherwise why the URL is rejected."""
    n = netloc(u)
    unbalanced = (F.instr(n, "[") > 0) != (F.instr(n, "]") > 0)
    return (
        F.when(u.isNull(), F.lit("null_url"))
        .when(unbalanced, F.lit("malformed"))
        .when(~scheme(u).isin(*ALLOWED_SCHEMES), F.lit("scheme"))
        .when(n == "", F.lit("no_host"))
        .when(host(u).isin(*LOCAL_HOSTS), F.lit("local_host"))
    )


def url_valid(u: Column) -> Column:
    return url_reject_reason(u).isNull()


def url_defrag(u: Column) -> Column:
    """Drop ``#fragment``."""
    return F.regexp_replace(u, r"#.*$", "")


def url_norm_key(u: Column) -> Column:
    """U4: strip every trailing ``/`` and lower-case the whole URL."""
    return F.lower(F.regexp_replace(u, r"/+$", ""))


def url_slug(u: Column) -> Column:
    """Last ``/`` segment after stripping trailing ``/``, lower-cased."""
    return F.lower(F.element_at(F.split(F.regexp_replace(u, r"/+$", ""), "/"), -1))


def is_child_slug(child_slug: Column, parent_slug: Column) -> Column:
    """Child slug starts with ``parent-``."""
    return F.startswith(child_slug, F.concat(parent_slug, F.lit("-")))


def href_usable(href: Column) -> Column:
    """U8: a stripped href that is non-empty and not an in-page, script or mail link.

    One regex, so the (often large) href expression is referenced once."""
    return F.coalesce(href.rlike(r"(?s)^(?!#|javascript:|mailto:)."), F.lit(False))


def same_site(u: Column, base: Column) -> Column:
    """Authority equal ignoring case (scheme not compared)."""
    return F.lower(netloc(u)) == F.lower(netloc(base))


URI_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(.*)$"


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.``/``..`` segments (``..`` at the top is dropped) of a path given as
    a plain column; a trailing dot segment leaves a trailing slash."""
    segs = F.split(path, "/")

    def step(acc, s):
        return (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(s == ".", acc)
                .otherwise(F.concat(acc, F.array(s))))
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    return F.array_join(F.aggregate(segs, F.array().cast("array<string>"), step,
                                    lambda acc: F.concat(acc, tail)), "/")


def with_resolved_url(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add column ``out`` = RFC 3986 resolution of column ``href`` against ``base``.

    Shapes: absolute (has a scheme), network path ``//host``, empty, fragment only,
    query only, absolute path ``/p``, and relative path (merged with the base
    directory, repeated ``/`` collapsed); dot segments are removed from the path.
    The parts are staged as columns so that no sub-expression is repeated in the plan.
    """
    h, b = F.col(href), F.col(base)
    t = df.select(
        "*",
        F.regexp_extract(h, URI_RE, 1).alias("_u_hs"), F.regexp_extract(h, URI_RE, 3).alias("_u_hp"),
        F.regexp_extract(h, URI_RE, 4).alias("_u_ht"), F.regexp_extract(b, URI_RE, 1).alias("_u_bs"),
        F.regexp_extract(b, URI_RE, 2).alias("_u_ba"), F.regexp_extract(b, URI_RE, 3).alias("_u_bp"),
        F.regexp_extract(b, r"^[^?#]*(\?[^#]*)?", 1).alias("_u_bq"))
    hp, bp = F.col("_u_hp"), F.col("_u_bp")
    t = t.withColumn("_u_mp", F.when(hp.startswith("/"), hp).otherwise(
        F.regexp_replace(F.concat(F.regexp_replace(bp, r"[^/]*$", ""), hp), r"/{2,}", "/")))
    mp = F.col("_u_mp")
    t = t.withColumn("_u_path", F.when(mp.rlike(r"(^|/)\.\.?(/|$)"), _remove_dot_segments(mp)).otherwise(mp))
    path = F.col("_u_path")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    prefix = F.concat(F.col("_u_bs"), F.lit(":"), F.col("_u_ba"))
    scheme = F.col("_u_hs")
    res = (F.when(scheme != "", F.concat(F.lower(scheme), h.substr(F.length(scheme) + 1, F.length(h))))
           .when(h.startswith("//"), F.concat(F.col("_u_bs"), F.lit(":"), h))
           .when(h == "", b)
           .when(h.startswith("#"), F.concat(prefix, bp, F.col("_u_bq"), h))
           .when(h.startswith("?"), F.concat(prefix, bp, h))
           .otherwise(F.concat(prefix, path, F.col("_u_ht"))))
    return t.withColumn(out, res).drop("_u_hs", "_u_hp", "_u_ht", "_u_bs", "_u_ba", "_u_bp",
                                        "_u_bq", "_u_mp", "_u_path")


def url_spans(text: Column) -> Column:
    """``array<struct<span_no, text, is_url>>`` — text cut at URL matches, in order."""
    urls = F.regexp_extract_all(text, F.lit(URL_SPAN_RE), 0)
    pieces = F.split(text, URL_SPAN_RE, -1)
    pairs = F.zip_with(
        pieces, F.concat(urls, F.array(F.lit(None).cast("string"))),
        lambda p, u: F.array(F.struct(p.alias("text"), F.lit(False).alias("is_url")),
                             F.struct(u.alias("text"), F.lit(True).alias("is_url"))))
    flat = F.filter(F.flatten(pairs), lambda s: s["text"].isNotNull() & (s["text"] != ""))
    return flat
