"""Text Column expressions (JVM-side, no Python per row).

H8 collapse_ws, H9 entity_decode, M1 matches_any, L2 title cleanup, B2 bookmark names,
B9 placeholders.
"""

from __future__ import annotations

from html.entities import name2codepoint
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------
# Python's str.split() whitespace set: \t \n \v \f \r, U+001C..U+001F, space, U+0085,
# U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's \s misses U+00A0 (the &nbsp; case), so the class is spelled out.  The
# \x{..} form is accepted by both Java regex and RE2 (the SQL oracle).
PY_WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_WS_RUN = PY_WS_CLASS + "+"

# Characters stripped from the left of a link title before the final trim.
TITLE_LSTRIP = "–—-•·‣»›:[] "

# Markdown: characters escaped anywhere; at a line's start; list numbers; in link targets.
MD_CHARS_RE = r"([\\`*_\[\]<>|~])"
MD_START_RE = r"^([#+=-])"
MD_NUMBER_RE = r"^([0-9]+)([.)])"
MD_TARGET = [(" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E")]

# Character references: decimal, hex, or a name.
# The ";" is required: without it the text stays as written, as do unknown names.
ENTITY_RE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"

# Named references come from the HTML 4 table of the Python standard library (plus
# &apos;), built by rule at import time rather than written out.
_NAMED = dict(name2codepoint)
_NAMED["apos"] = 39


_PAIR_SEP, _KV_SEP = "\u0001", "\u0002"


def _named_entity_map() -> Column:
    """Name -> character map as ONE string literal folded by ``str_to_map`` (a map
    built from hundreds of literal nodes would bloat every plan that decodes text)."""
    packed = _PAIR_SEP.join(f"{name}{_KV_SEP}{chr(cp)}" for name, cp in sorted(_NAMED.items()))
    return F.str_to_map(F.lit(packed), F.lit(_PAIR_SEP), F.lit(_KV_SEP))


def collapse_ws(col: Column) -> Column:
    """Python ``" ".join(s.split())``: whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, F.lit(PY_WS_RUN), F.lit(" ")))


def decode_entities(col: Column) -> Column:
    """Decode character references in one left-to-right pass (``&amp;lt;`` -> ``&lt;``).

    The text is split at references; each reference is decoded with built-ins
    (numeric via UTF-32 bytes, named via a literal map) and the pieces are zipped back.
    Unknown names stay as written.  Strings without ``&`` skip the work.
    """
    ents = F.regexp_extract_all(col, F.lit(ENTITY_RE), 0)
    pieces = F.split(col, ENTITY_RE, -1)
    names = _named_entity_map()

    def decode_one(e: Column) -> Column:
        n = F.length(e)
        core = e.substr(F.lit(2), n - F.lit(2))  # without '&' and ';'
        is_hex = core.startswith("#x") | core.startswith("#X")
        is_dec = core.startswith("#") & ~is_hex
        # without leading zeros; a number too long for any character is none
        digits = F.ltrim(F.when(is_hex, core.substr(F.lit(3), n)).otherwise(core.substr(F.lit(2), n)), F.lit("0"))
        fits = F.length(digits) <= 7
        hex_digits = F.when(is_hex, digits).when(is_dec & fits, F.hex(digits.try_cast("long")))
        cp_ok = F.when(fits, F.conv(hex_digits, 16, 10).cast("long"))
        numeric = F.when(
            (cp_ok > 0) & (cp_ok <= 0x10FFFF) & ~((cp_ok >= 0xD800) & (cp_ok <= 0xDFFF)),
            F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32"),
        ).otherwise(F.lit("�"))
        named = F.coalesce(F.element_at(names, core), e)
        return F.when(is_hex | is_dec, numeric).otherwise(named)

    decoded = F.transform(ents, decode_one)
    joined = F.array_join(
        F.zip_with(pieces, F.concat(decoded, F.array(F.lit(""))),
                   lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))),
        "",
    )
    return F.when(F.instr(col, "&") > 0, joined).otherwise(col)


class Compiled(NamedTuple):
    """Markers of many configs, compiled per row: a pattern column (``marker_pattern``)."""
    pattern: Column


def marker_pattern(markers: Column) -> Column:
    """An array of markers as one alternation of quoted lower-case literals; NULL for none."""
    quoted = F.transform(markers, lambda m: F.concat(
        F.lit("\\Q"), F.replace(F.lower(m), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(markers) > 0, F.array_join(quoted, "|"))


def matches_any(text: Column, markers) -> Column:
    """M1: any marker is a case-insensitive substring of ``text``.

    Empty list -> false; an empty-string marker matches every row (images too).
    ``markers`` is a Python list (compiled to an OR of ``instr`` tests, fully
    code-generated), an array column (evaluated with ``exists``) or ``Compiled`` (one regex
    test; the rows of a page follow each other, so a pattern is compiled once for all of them).
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if isinstance(markers, Compiled):
        return F.coalesce(F.rlike(low, markers.pattern), F.lit(False))
    if isinstance(markers, (list, tuple)):
        cond = F.lit(False)
        for m in markers:
            cond = cond | (F.instr(low, F.lit(m.lower())) > 0)
        return cond
    return F.coalesce(
        F.exists(F.coalesce(markers, F.array().cast("array<string>")),
                 lambda m: F.instr(low, F.lower(m)) > 0),
        F.lit(False),
    )


def md_escape(text: Column) -> Column:
    """Characters that mean something in Markdown, wherever they stand, as themselves."""
    return F.regexp_replace(text, MD_CHARS_RE, r"\\$1")


def md_line_start(text: Column) -> Column:
    """A line that would open a heading, list, rule or quote is kept a plain line."""
    return F.regexp_replace(F.regexp_replace(text, MD_START_RE, r"\\$1"), MD_NUMBER_RE, r"$1\\$2")


def md_target(url: Column) -> Column:
    """A link target that ends where it should: spaces, parentheses and angle brackets escaped."""
    for char, code in MD_TARGET:
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: trim the full Unicode whitespace set at both ends."""
    return F.regexp_replace(col, r"^" + PY_WS_RUN + r"|" + PY_WS_RUN + r"$", "")


def clean_link_title(title: Column, url: Column) -> Column:
    """L2: stripped anchor text (URL if empty), left-stripped of list-marker
    characters, then stripped; the URL again if nothing is left."""
    first = F.when(title == "", url).otherwise(title)
    stripped = py_strip(F.ltrim(first, F.lit(TITLE_LSTRIP)))
    return F.when(stripped == "", url).otherwise(stripped)


def bookmark_name(index: Column, title: Column) -> Column:
    """B2: ``ch_{index}_{first 30 of title with non-alphanumerics as single _}``."""
    safe = F.regexp_replace(title, r"[^a-zA-Z0-9]", "_")
    safe = F.regexp_replace(safe, r"_+", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.concat(F.lit("ch_"), index.cast("string"), F.lit("_"),
                    F.substring(safe, 1, 30))


def fill_placeholders(text: Column, title: Column) -> Column:
    """``XXX1`` then ``HHH1`` replaced by the book title (a missing one is empty)."""
    title = F.coalesce(title, F.lit(""))
    return F.replace(F.replace(text, F.lit("XXX1"), title), F.lit("HHH1"), title)
