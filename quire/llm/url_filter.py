"""URL filters: rules by host and path, and redirect equivalence for what no rule fits.

Pages that redirect to each other or name a canonical address are one resource.  Links between
addresses -- redirects and canonical tags found in the pages, and the canonical form of each
address -- are closed by distributed connected components.  A block decision for any address of
a component blocks its other addresses, unless an explicit allow fits one of them: allow takes
precedence, and an address that a rule fits itself keeps that rule's verdict.

Rules are a short table and become one expression; addresses and links are only joined and
grouped, so a component may hold any share of all addresses.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
belongs to no component; it is allowed.  Repeated rows get equal verdicts; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import with_resolved_url
from quire.llm.components import components


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Query parameters that don't change what an address names.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null where none fits.  Of equally
    long ones an allow comes first, then the one that sorts first."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def canonical_form(url: Column) -> Column:
    """The address without its scheme's security, ``www.`` and ``m.``, a fragment, tracking
    parameters, a trailing ``/`` or ``.html``: what a site's own canonical link would name."""
    host = F.regexp_replace(url_host(url), r"^(?:www\.|m\.)++", "")
    path = F.regexp_replace(url_path(url), r"(/(index)?\.html?|\.html?|/)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})="))), "&")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): canonical links and refresh redirects that pages declare, from all such tags with
    their attributes in any order; targets are resolved against the page's address (RFC 3986)."""
    def attribute(tag: Column, name: str) -> Column:
        pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
        return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))

    def tags(name: str) -> Column:
        return F.regexp_extract_all(F.col(html_col), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))

    links = F.transform(F.filter(tags("link"), lambda t: attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")),
                        lambda t: attribute(t, "href"))
    metas = F.transform(F.filter(tags("meta"), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"),
                        lambda t: F.regexp_extract(attribute(t, "content"), r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = pages.select(F.col(url_col).alias("src"), F.explode(F.concat(links, metas)).alias("href"))
    return with_resolved_url(found.filter("href <> '' and src is not null"), "src", "href", "dst").select("src", "dst")


def judge_urls(urls: DataFrame, links: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: ``id_col``, host, path, rule, verdict, ``component`` (the least address
    of its equivalence class, null for a class of one) and ``verdict_by`` (rule, alias, default).
    ``links`` is (src, dst) between addresses."""
    own = urls.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    known = own.select("_url").filter(F.col("_url").contains("://")).distinct()
    canonical = known.select(F.col("_url").alias("src"), canonical_form(F.col("_url")).alias("dst"))
    both = links.select(F.col("src").cast("string"), F.col("dst").cast("string")).filter(
        F.col("src").contains("://") & F.col("dst").contains("://"))
    both = both.unionAll(canonical).unionAll(both.select(F.col("dst").alias("src"), canonical_form(F.col("dst")).alias("dst")))
    member = components(both, "src", "dst")

    # every address of a component counts, those that links name and no row has as well
    said = member.withColumn("_f", fitting_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"])
    verdicts = said.groupBy("component").agg(F.max(F.col("_f") == "allow").alias("_allow"), F.max(F.col("_f") == "block").alias("_block"))
    alias = member.join(verdicts, "component").select(
        F.col("node").alias("_node"), "component",
        (F.coalesce("_block", F.lit(False)) & ~F.coalesce("_allow", F.lit(False))).alias("_blocked"))
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    rows = own.join(alias, F.col("_url") == F.col("_node"), "left").select(
        id_col, host.alias("host"), path.alias("path"), fitting_rule(host, path, rules).alias("_rule"), "component", "_blocked")
    blocked = F.coalesce("_blocked", F.lit(False))
    return rows.select(
        id_col, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"), "component",
        F.when(F.col("_rule").isNotNull(), "rule").when(blocked, "alias").otherwise("default").alias("verdict_by"))
