"""Independent SQL (DuckDB dialect) for the registered queries.

Each statement recomputes a query from the driver's tables with plain SQL window
functions, so it checks the Spark operators rather than re-running them.  Regex
constants are shared with the library (they are part of the specification); the
logic is written out again in SQL.  Entity decoding here covers the references that
occur in the driver's data (``&amp; &lt; &gt; &quot; &apos; &nbsp; &copy; &middot;``);
the library decodes every HTML 4 name and numeric reference.
"""

from __future__ import annotations

from quire.functions.text import ENTITY_RE, MD_CHARS_RE, MD_NUMBER_RE, MD_START_RE, MD_TARGET, PY_WS_RUN, TITLE_LSTRIP  # noqa: F401
from quire.functions.urls import LOCAL_HOSTS, NETLOC_RE, SCHEME_RE, URI_RE, URL_SPAN_RE
from quire.operators import html as H
from quire.operators.book import BIG_FONT_FROM_CHAPTER, BIG_FONT_PT, END, INTRO_TITLE, PLACEHOLDER, TOC_TITLE
from quire.operators.links import RESERVED_TITLES
from quire.operators.slices import SOURCE_PREFIX
from quire.plans import queries as Q
from quire.plans.site_fixture import SITE_CONFIG, SITE_SQL


# The SQL nests elements by running counts, not by a stack: these are its own sets.
WRAPPER_TAGS = ["div", "section", "article", "main", "ul", "ol", "dl", "table",
                "thead", "tbody", "tfoot", "tr", "body"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"]

#: RE2 never backtracks, so it needs no possessive marks (nor knows them).
TOKEN_RE = H.TOKEN_RE.replace("*+", "*").replace("++", "+")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


WRUN = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WPAGE = "(PARTITION BY page_id)"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(PY_WS_RUN)}, ' ', 'g'))"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + PY_WS_RUN + '|' + PY_WS_RUN + '$')}, '', 'g')"


def decode(x: str) -> str:
    out = x
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def md_escape(x: str) -> str:
    return f"regexp_replace({x}, {lit(MD_CHARS_RE)}, {lit(chr(92) * 3 + '1')}, 'g')"


def md_line_start(x: str) -> str:
    once = f"regexp_replace({x}, {lit(MD_START_RE)}, {lit(chr(92) * 3 + '1')})"
    return f"regexp_replace({once}, {lit(MD_NUMBER_RE)}, {lit(chr(92) + '1' + chr(92) * 3 + '2')})"


def matches_any(x: str, markers) -> str:
    if not markers:
        return "false"
    return "(" + " OR ".join(f"strpos(lower(coalesce({x}, '')), lower({lit(m)})) > 0" for m in markers) + ")"


def attr(tk: str, name: str) -> str:
    pat = r"(?i)\s" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return (f"(regexp_extract({tk}, {lit(pat)}, 1) || regexp_extract({tk}, {lit(pat)}, 2) || "
            f"regexp_extract({tk}, {lit(pat)}, 3))")


def has_attr(tk: str, name: str) -> str:
    return f"regexp_matches({tk}, {lit(r'(?i)\s' + name + r'(\s*=|[\s/>])')})"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, {lit(NETLOC_RE)}, 1)"


def norm_key(u: str) -> str:
    return f"lower(regexp_replace({u}, '/+$', ''))"


def slug(u: str) -> str:
    return f"lower(string_split(regexp_replace({u}, '/+$', ''), '/')[-1])"


def defrag(u: str) -> str:
    return f"regexp_replace({u}, '#.*$', '')"


def reject_reason(u: str) -> str:
    n = netloc(u)
    n2 = f"regexp_replace({n}, '^.*@', '')"
    host = (f"lower(CASE WHEN starts_with({n2}, '[') THEN regexp_extract({n2}, '^\\[([^\\]]*)\\]', 1) "
            f"ELSE regexp_replace({n2}, ':[^:]*$', '') END)")
    sch = f"lower(regexp_extract({u}, {lit(SCHEME_RE)}, 1))"
    return (f"CASE WHEN {u} IS NULL THEN 'null_url' "
            f"WHEN (strpos({n}, '[') > 0) <> (strpos({n}, ']') > 0) THEN 'malformed' "
            f"WHEN {sch} NOT IN ('http', 'https') THEN 'scheme' WHEN {n} = '' THEN 'no_host' "
            f"WHEN {host} IN {lits(LOCAL_HOSTS)} THEN 'local_host' END")


def resolve_cte(name: str, src: str, base: str, href: str, out: str) -> str:
    """CTEs ``{name}_a``..``{name}`` adding column ``out`` = href resolved against base."""
    return f"""
{name}_a AS (SELECT *, regexp_extract({href}, {lit(URI_RE)}, 1) AS _hs, regexp_extract({href}, {lit(URI_RE)}, 3) AS _hp,
    regexp_extract({href}, {lit(URI_RE)}, 4) AS _ht, regexp_extract({base}, {lit(URI_RE)}, 1) AS _bs,
    regexp_extract({base}, {lit(URI_RE)}, 2) AS _ba, regexp_extract({base}, {lit(URI_RE)}, 3) AS _bp,
    regexp_extract({base}, '^[^?#]*(\\?[^#]*)?', 1) AS _bq FROM {src}),
{name}_b AS (SELECT *, CASE WHEN starts_with(_hp, '/') THEN _hp
    ELSE regexp_replace(regexp_replace(_bp, '[^/]*$', '') || _hp, '/{{2,}}', '/', 'g') END AS _mp FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN regexp_matches(_mp, '(^|/)\\.\\.?(/|$)') THEN
    array_to_string(list_concat(list_reduce(string_split(_mp, '/'), lambda acc, s:
        CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] WHEN s = '.' THEN acc ELSE list_append(acc, s) END,
        []::VARCHAR[]), CASE WHEN string_split(_mp, '/')[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END), '/')
    ELSE _mp END AS _path0 FROM {name}_b),
{name} AS (SELECT * EXCLUDE (_hs, _hp, _ht, _bs, _ba, _bp, _bq, _mp, _path0),
    CASE WHEN _hs <> '' THEN lower(_hs) || substr({href}, length(_hs) + 1)
         WHEN starts_with({href}, '//') THEN _bs || ':' || {href}
         WHEN {href} = '' THEN {base}
         WHEN starts_with({href}, '#') THEN _bs || ':' || _ba || _bp || _bq || {href}
         WHEN starts_with({href}, '?') THEN _bs || ':' || _ba || _bp || {href}
         ELSE _bs || ':' || _ba || CASE WHEN starts_with(_path0, '/') THEN _path0 ELSE '/' || _path0 END || _ht
    END AS {out} FROM {name}_c)"""


# ------------------------------------------------------------------ ordered text
def lines_cte() -> str:
    return f"""lines AS (
  SELECT doc_id AS page_id, CAST(i - 1 AS INTEGER) AS idx, full_text FROM (
    SELECT doc_id, unnest(l) AS full_text, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
             lambda s: {collapse('s')}), lambda s: s <> '') AS l FROM documents)))"""


def bounds_cte(src: str, start, stop, name: str = "bounds") -> str:
    return f"""{name}_f AS (SELECT *, min(CASE WHEN {matches_any('full_text', start)} THEN idx END) OVER {WPAGE} AS _f FROM {src}),
{name}_s AS (SELECT * EXCLUDE (_f), CASE WHEN _f IS NOT NULL THEN greatest(0, _f - 1) END AS slice_start FROM {name}_f),
{name} AS (SELECT *, min(CASE WHEN {matches_any('full_text', stop)} AND idx > slice_start THEN idx END) OVER {WPAGE} AS slice_stop FROM {name}_s)"""


KEEP = "(idx >= slice_start AND (slice_stop IS NULL OR idx < slice_stop))"
REMOVED = f"lower(full_text) IN {lits([x.lower() for x in Q.REMOVE_LINES])}"


def sql_lines_slice() -> str:
    return f"""WITH {lines_cte()}, {bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)}
SELECT page_id AS doc_id, idx, full_text FROM bounds WHERE {KEEP}"""


def sql_lines_bounds() -> str:
    return f"""WITH {lines_cte()}, {bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)}
SELECT page_id AS doc_id, count(*) AS items_parsed, count(*) FILTER (WHERE {KEEP}) AS items_sliced,
  max(CAST(slice_start IS NOT NULL AS INTEGER)) AS has_start, max(CAST(slice_stop IS NOT NULL AS INTEGER)) AS has_stop
FROM bounds GROUP BY page_id"""


def sql_lines_remove_text() -> str:
    return f"""WITH {lines_cte()}, {bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)}
SELECT page_id AS doc_id, idx, full_text FROM bounds WHERE {KEEP} AND NOT {REMOVED}"""


def sql_lines_remove_table() -> str:
    return f"""WITH {lines_cte()}, common AS (SELECT lower(full_text) AS t FROM lines GROUP BY 1 HAVING count(DISTINCT page_id) >= {Q.COMMON_FROM}),
{bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)}
SELECT page_id AS doc_id, idx, full_text FROM bounds WHERE {KEEP} AND lower(full_text) NOT IN (SELECT t FROM common)"""


def sql_lines_source() -> str:
    return f"""WITH {lines_cte()}, {bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)},
kept AS (SELECT page_id, idx, full_text FROM bounds WHERE slice_start IS NOT NULL AND {KEEP} AND NOT {REMOVED}),
src AS (SELECT DISTINCT b.page_id, {1 << 30} AS idx, {lit(SOURCE_PREFIX)} || d.source AS full_text
  FROM bounds b JOIN documents d ON d.doc_id = b.page_id
  WHERE b.slice_start IS NOT NULL AND d.source IS NOT NULL AND d.source <> ''),
u AS (SELECT * FROM kept UNION ALL SELECT * FROM src)
SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS idx, full_text FROM u"""


def sql_lines_dedup() -> str:
    return f"""WITH {lines_cte()}
SELECT page_id AS doc_id, idx, full_text FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, full_text ORDER BY idx) AS r FROM lines) WHERE r = 1"""


def sql_turns_slice() -> str:
    return f"""WITH turns AS (
  SELECT conv_id AS page_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx,
         role, {collapse("coalesce(text, '')")} AS full_text FROM conversations),
{bounds_cte('turns', Q.TURN_START, Q.TURN_STOP)}
SELECT page_id AS conv_id, idx, role, full_text FROM bounds WHERE {KEEP}"""


# ------------------------------------------------------------------ URLs
def sql_url_parts() -> str:
    u = "url"
    n2 = f"regexp_replace({netloc(u)}, '^.*@', '')"
    host = (f"lower(CASE WHEN starts_with({n2}, '[') THEN regexp_extract({n2}, '^\\[([^\\]]*)\\]', 1) "
            f"ELSE regexp_replace({n2}, ':[^:]*$', '') END)")
    return f"""SELECT page_id, url, lower(regexp_extract(url, {lit(SCHEME_RE)}, 1)) AS scheme, {netloc(u)} AS netloc,
  {host} AS host, {defrag(u)} AS defrag, {norm_key(defrag(u))} AS norm_key, {slug(defrag(u))} AS slug,
  {reject_reason(u)} AS reject_reason FROM pages"""


def sql_url_valid() -> str:
    rest = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*', '')"
    tail = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*/?', '')"
    parts = []
    for name, pat in Q.URL_VARIANTS:
        pieces, out = pat.replace("}", "{").split("{"), []
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                if piece:
                    out.append(lit(piece))
            else:
                out.append({"u": "url", "rest": rest, "tail": tail, "netloc": netloc("url")}[piece])
        parts.append(f"SELECT page_id, {lit(name)} AS variant, {' || '.join(out)} AS url FROM pages")
    return f"""WITH v AS ({' UNION ALL '.join(parts)})
SELECT page_id, variant, url, {reject_reason('url')} AS reject_reason FROM v"""


def sql_url_resolve() -> str:
    shapes = "[" + ", ".join(lit(h) for h in Q.HREF_SHAPES) + "]"
    return f"""WITH x AS (
  SELECT page_id, url AS base, CAST(generate_subscripts({shapes}, 1) - 1 AS INTEGER) AS shape, unnest({shapes}) AS href FROM pages),
{resolve_cte('r', 'x', 'base', 'href', 'resolved')}
SELECT page_id, shape, base, href, resolved, {defrag('resolved')} AS defrag FROM r"""


def sql_url_spans() -> str:
    return f"""WITH t AS (SELECT page_id, 'See ' || url || ' or www.example.org/' || CAST(page_id AS VARCHAR) || chr(160) || 'for more.' AS text FROM pages),
s AS (SELECT page_id, list_filter(flatten(list_transform(
         generate_series(1, len(regexp_split_to_array(text, {lit(URL_SPAN_RE)}))),
         lambda i: [{{'text': regexp_split_to_array(text, {lit(URL_SPAN_RE)})[i], 'is_url': false}},
                    {{'text': regexp_extract_all(text, {lit(URL_SPAN_RE)}, 0)[i], 'is_url': true}}])),
         lambda x: x.text IS NOT NULL AND x.text <> '') AS spans FROM t)
SELECT page_id, CAST(generate_subscripts(spans, 1) - 1 AS INTEGER) AS span_no, unnest(spans).text AS text,
       unnest(spans).is_url AS is_url FROM s"""


def sql_manifest() -> str:
    names = Q.MANIFEST_NAMES
    types = Q.MANIFEST_TYPES
    return f"""WITH b AS (
  SELECT page_id * {len(names) * len(types)} + ni * {len(types)} + ti AS book_id, url, out_name, book_type FROM pages,
    (SELECT unnest({'[' + ', '.join(lit(x) for x in names) + ']'}) AS out_name,
            generate_subscripts({'[' + ', '.join(lit(x) for x in names) + ']'}, 1) - 1 AS ni) n,
    (SELECT unnest({'[' + ', '.join(lit(x) for x in types) + ']'}) AS book_type,
            generate_subscripts({'[' + ', '.join(lit(x) for x in types) + ']'}, 1) - 1 AS ti) t)
SELECT book_id, url, 'english' AS language, book_type, out_name,
  coalesce({reject_reason('url')},
    CASE WHEN out_name IS NULL OR out_name = '' THEN 'no_output'
         WHEN list_contains(regexp_split_to_array(coalesce(out_name, ''), '[/\\\\]'), '..') THEN 'parent_dir'
         WHEN NOT regexp_matches(lower(out_name), '\\.docx$') THEN 'not_docx' END,
    CASE WHEN book_type NOT IN ('main', 'other') THEN 'book_type' END) AS reject_reason
FROM b"""


# ------------------------------------------------------------------ HTML
def tokens_ctes(src: str = "pages") -> str:
    return f"""tok0 AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), {lit(H.RAW_TEXT_RE)}, {lit(H.SEPARATOR)}, 'g') AS h FROM {src}),
tok1 AS (SELECT page_id, url, unnest(l) AS tk, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos
         FROM (SELECT page_id, url, regexp_extract_all(h, {lit(TOKEN_RE)}, 0) AS l FROM tok0)),
tok2 AS (SELECT *, CASE WHEN regexp_matches(tk, '^<[A-Za-z]') THEN 'open' WHEN regexp_matches(tk, '^</[A-Za-z]') THEN 'close'
         WHEN starts_with(tk, '<!') OR starts_with(tk, '<?') THEN 'other' ELSE 'text' END AS kind FROM tok1),
tok AS (SELECT page_id, pos, tk, kind,
         CASE WHEN kind <> 'text' THEN lower(regexp_extract(tk, {lit(H.TAG_NAME_RE)}, 1)) END AS tag,
         CASE WHEN kind = 'open' AND lower(regexp_extract(tk, {lit(H.TAG_NAME_RE)}, 1)) IN ('a', 'img') THEN url END AS base_url
         FROM tok2 WHERE kind <> 'other')"""


def _since(value: str, resets: str) -> str:
    """Running minimum since the last of the counted resets."""
    return f"min({value} - {resets} * 2147483648) OVER {WRUN} + {resets} * 2147483648"


def strip_ctes(src: str, tags, out: str = "strip") -> str:
    wrap = lits(WRAPPER_TAGS)
    own = [x for x in tags if x not in H.RAW_TEXT_TAGS]
    opens = [f"kind = 'open' AND tag = {lit(x)} AND NOT ends_with(tk, '/>')" for x in own]
    one = ", ".join(f"sum(CASE WHEN {o} THEN 1 WHEN kind = 'close' AND tag = {lit(x)} THEN -1 ELSE 0 END) OVER {WRUN} AS _s{i}, "
                    f"last_value(CASE WHEN {o} THEN _W END IGNORE NULLS) OVER {WRUN} AS _l{i}" for i, (x, o) in enumerate(zip(own, opens)))
    ends = [f"coalesce(kind = 'close' AND tag IN {wrap} AND _W < _l{i}, false)" for i in range(len(own))]
    two = ", ".join(f"sum(CAST({e} AS INTEGER)) OVER {WRUN} AS _n{i}, "
                    f"coalesce(last_value(CASE WHEN {e} THEN _s{i} END IGNORE NULLS) OVER {WRUN}, 0) AS _b{i}" for i, e in enumerate(ends))
    three = ", ".join(f"{_since(f'(_s{i} - _b{i})', f'_n{i}')} AS _m{i}" for i in range(len(own)))
    inside = " OR ".join(f"_s{i} - _b{i} - least(0, _m{i}) > 0" for i in range(len(own)))
    return f"""{out}_0 AS (SELECT *, sum({_delta(f'tag IN {wrap}')}) OVER {WRUN} AS _W FROM {src}),
{out}_1 AS (SELECT *, {one} FROM {out}_0),
{out}_2 AS (SELECT *, {two} FROM {out}_1),
{out}_3 AS (SELECT *, {three} FROM {out}_2),
{out} AS (SELECT page_id, pos, tk, kind, tag, base_url FROM {out}_3
  WHERE NOT ({inside}) AND NOT coalesce(tag IN {lits(tags)}, false))"""


def root_ctes(src: str, mode: str = "auto", out: str = "root") -> str:
    def first(cond):
        return f"min(CASE WHEN {cond} THEN pos END) OVER {WPAGE}"
    if mode == "auto":
        cands = [("article", first("kind = 'open' AND tag = 'article'")),
                 ("main", first("kind = 'open' AND tag = 'main'")),
                 ("div", first(f"kind = 'open' AND tag = 'div' AND regexp_matches({attr('tk', 'class')}, {lit(H.ROOT_CLASS_RE)})")),
                 ("body", first("kind = 'open' AND tag = 'body'"))]
    else:
        cands = [("body", first("kind = 'open' AND tag = 'body'"))]
    cols = ", ".join(f"{c} AS _r_{n}" for n, c in cands)
    rp = "coalesce(" + ", ".join(f"_r_{n}" for n, _ in cands) + ")"
    rt = "CASE " + " ".join(f"WHEN _r_{n} IS NOT NULL THEN '{n}'" for n, _ in cands) + " END"
    drop = ", ".join(f"_r_{n}" for n, _ in cands)
    return f"""{out}_1 AS (SELECT *, {cols} FROM {src}),
{out}_2 AS (SELECT * EXCLUDE ({drop}), {rp} AS _rp, {rt} AS _rt FROM {out}_1),
{out}_3 AS (SELECT *, sum(CASE WHEN pos >= _rp AND tag = _rt AND kind = 'open' THEN 1
                              WHEN pos >= _rp AND tag = _rt AND kind = 'close' THEN -1 ELSE 0 END) OVER {WRUN} AS _c FROM {out}_2),
{out}_4 AS (SELECT *, min(CASE WHEN pos > _rp AND tag = _rt AND kind = 'close' AND _c = 0 THEN pos END) OVER {WPAGE} AS _re FROM {out}_3),
{out} AS (SELECT * EXCLUDE (_rp, _rt, _c, _re) FROM {out}_4 WHERE _rp IS NULL OR (pos > _rp AND (_re IS NULL OR pos < _re)))"""


def _delta(open_tags, close_tags=None) -> str:
    return f"CASE WHEN kind = 'open' AND {open_tags} THEN 1 WHEN kind = 'close' AND {close_tags or open_tags} THEN -1 ELSE 0 END"


def segment_ctes(src: str, out: str = "seg") -> str:
    blk, wrap, void = lits(H.BLOCK_TAGS), lits(WRAPPER_TAGS), lits(VOID_TAGS)
    w = "(PARTITION BY page_id, _W, _scope, _bound ORDER BY pos)"
    heads = lits(list(H.HEADING_STYLE))

    def depth(c):
        return f"(_{c}rel - least(0, _{c}min))"
    return f"""{out}_1 AS (SELECT *, coalesce(kind IN ('open', 'close') AND tag IN {blk}, false) AS _bound FROM {src}),
{out}_2 AS (SELECT *, sum(CAST(_bound AS INTEGER)) OVER {WRUN} AS _nb,
    sum({_delta(f'tag IN {wrap}')}) OVER {WRUN} AS _W,
    sum({_delta(f'tag NOT IN {blk} AND tag NOT IN {void}')}) OVER {WRUN} AS _I,
    sum({_delta("tag IN ('b', 'strong')")}) OVER {WRUN} AS _B,
    sum({_delta("tag IN ('i', 'em')")}) OVER {WRUN} AS _It,
    sum({_delta("tag IN ('ul', 'ol')")}) OVER {WRUN} AS _L
  FROM {out}_1),
{out}_2a AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'open' AND tag IN {wrap} THEN pos END IGNORE NULLS)
    OVER (PARTITION BY page_id, _W ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS _scope FROM {out}_2),
{out}_2b AS (SELECT *, lead(tag, 1) OVER {w} AS _nxt_tag, lead(kind, 1) OVER {w} AS _nxt_kind FROM {out}_2a),
{out}_3 AS (SELECT *,
    last_value(CASE WHEN _bound THEN _W END IGNORE NULLS) OVER {WRUN} AS _W0,
    last_value(CASE WHEN _bound THEN _I END IGNORE NULLS) OVER {WRUN} AS _I0,
    last_value(CASE WHEN _bound THEN _B END IGNORE NULLS) OVER {WRUN} AS _B0,
    last_value(CASE WHEN _bound THEN _It END IGNORE NULLS) OVER {WRUN} AS _It0,
    last_value(CASE WHEN _bound THEN tag END IGNORE NULLS) OVER {WRUN} AS seg_tag,
    last_value(CASE WHEN _bound THEN kind END IGNORE NULLS) OVER {WRUN} AS seg_kind,
    last_value(CASE WHEN _bound THEN pos END IGNORE NULLS) OVER {WRUN} AS seg_pos,
    last_value(CASE WHEN _bound THEN _L END IGNORE NULLS) OVER {WRUN} AS list_depth
  FROM {out}_2b),
{out}_4 AS (SELECT *, _W - _W0 AS _wrel, _I - _I0 AS _irel, _B - _B0 AS _brel, _It - _It0 AS _itrel FROM {out}_3),
{out}_5 AS (SELECT *, {_since('_wrel', '_nb')} AS _wmin, {_since('_irel', '_nb')} AS _imin,
    {_since('_brel', '_nb')} AS _bmin, {_since('_itrel', '_nb')} AS _itmin FROM {out}_4),
{out}_6 AS (SELECT *, coalesce(kind = 'open' AND tag = 'br' AND {depth('i')} = 0 AND seg_kind = 'open', false) AS _brs FROM {out}_5),
{out}_7 AS (SELECT *, last_value(CASE WHEN _bound OR _brs THEN pos END IGNORE NULLS) OVER {WRUN} AS part_pos FROM {out}_6),
{out} AS (SELECT page_id, pos, tk, kind, tag, base_url, seg_pos, seg_tag, seg_kind, part_pos,
    _wmin >= 0 AS in_block, {depth('b')} > 0 AS bold, {depth('it')} > 0 AS italic, list_depth, _L AS _L_here, _bound AS seg_head,
    _bound AND coalesce(_nxt_kind = 'open' AND NOT (tag = 'p' OR (tag = 'li' AND _nxt_tag = 'li')
      OR (tag IN ('td', 'th') AND _nxt_tag IN ('td', 'th')) OR (tag IN {heads} AND _nxt_tag IN {heads})), false) AS container
  FROM {out}_7)"""


def items_ctes(seg: str, include_images: bool, out: str = "items") -> str:
    img = ""
    if include_images:
        img = f""",
{out}_im0 AS (SELECT page_id, pos, part_pos, seg_pos, seg_kind, in_block, base_url,
    {py_strip(decode(attr('tk', 'src')))} AS _src, {py_strip(decode(attr('tk', 'alt')))} AS _alt
  FROM {seg} WHERE kind = 'open' AND tag = 'img'),
{out}_im1 AS (SELECT * FROM {out}_im0 WHERE _src <> '' AND NOT starts_with(_src, 'data:')),
{resolve_cte(out + '_im2', out + '_im1', 'base_url', '_src', '_img_url')},
{out}_im AS (SELECT page_id, 'image' AS type,
    CASE WHEN coalesce(seg_kind = 'open' AND in_block, false) THEN seg_pos END AS seg_pos,
    NULL::VARCHAR AS seg_tag, NULL::BIGINT AS list_depth, '' AS full_text, 0 AS n_runs, '' AS bold_text,
    NULL::VARCHAR AS markup, NULL AS runs,
    _img_url AS img_url, CASE WHEN _alt <> '' THEN _alt ELSE 'Image' END AS alt,
    coalesce(seg_kind = 'open' AND in_block, false) AS _in_block,
    CASE WHEN coalesce(seg_kind = 'open' AND in_block, false) THEN part_pos ELSE pos END AS k1, 1 AS k2, pos AS k3,
    NULL::VARCHAR AS _list_tag, NULL::BOOLEAN AS container FROM {out}_im2)"""
    union_img = f" UNION ALL BY NAME SELECT * FROM {out}_im" if include_images else ""
    return f"""{out}_r0 AS (SELECT *, kind = 'text' AND in_block AS _is_run FROM {seg} WHERE seg_kind = 'open'),
{out}_r1 AS (SELECT *, CASE WHEN _is_run THEN {collapse(decode('tk'))} END AS text FROM {out}_r0 WHERE _is_run OR seg_head),
{out}_p AS (SELECT page_id, part_pos, any_value(seg_pos) AS seg_pos, any_value(seg_tag) AS seg_tag,
    any_value(list_depth) AS list_depth,
    coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE _is_run AND text <> ''), '') AS full_text,
    count(*) FILTER (WHERE _is_run AND text <> '') AS n_runs,
    coalesce(string_agg(text, '|' ORDER BY pos) FILTER (WHERE _is_run AND text <> '' AND bold), '') AS bold_text,
    string_agg(CASE WHEN bold AND italic THEN '***' || {md_escape('text')} || '***' WHEN bold THEN '**' || {md_escape('text')} || '**'
                    WHEN italic THEN '*' || {md_escape('text')} || '*' ELSE {md_escape('text')} END, ' ' ORDER BY pos)
      FILTER (WHERE _is_run AND text <> '') AS markup,
    list({{'text': text, 'bold': bold, 'italic': italic}} ORDER BY pos) FILTER (WHERE _is_run AND text <> '') AS runs,
    max(container) AS container
  FROM {out}_r1 GROUP BY page_id, part_pos),
{out}_ev AS (SELECT page_id, 'event' AS type, NULL::BIGINT AS seg_pos, NULL::VARCHAR AS seg_tag, _L_here AS list_depth,
    NULL::VARCHAR AS full_text, 0 AS n_runs, '' AS bold_text, NULL::VARCHAR AS markup, NULL AS runs, NULL::VARCHAR AS img_url,
    NULL::VARCHAR AS alt, false AS _in_block, pos AS k1, 0 AS k2, pos AS k3, tag AS _list_tag, NULL::BOOLEAN AS container
  FROM {seg} WHERE kind = 'open' AND tag IN ('ul', 'ol')){img},
{out}_u AS (SELECT page_id, 'text' AS type, seg_pos, seg_tag, list_depth, full_text, n_runs, bold_text, markup, runs,
    NULL::VARCHAR AS img_url, NULL::VARCHAR AS alt, true AS _in_block, part_pos AS k1, 0 AS k2, part_pos AS k3,
    NULL::VARCHAR AS _list_tag, container FROM {out}_p
  UNION ALL BY NAME SELECT * FROM {out}_ev{union_img}),
{out}_c AS (SELECT *, coalesce(max(container) OVER (PARTITION BY page_id, seg_pos), false) AS _container FROM {out}_u),
{out}_f AS (SELECT * EXCLUDE (k1, k2),
    CASE WHEN type = 'image' AND NOT (seg_pos IS NOT NULL AND NOT _container AND _in_block) THEN k3 ELSE k1 END AS k1,
    CASE WHEN type = 'image' AND NOT (seg_pos IS NOT NULL AND NOT _container AND _in_block) THEN 0 ELSE k2 END AS k2
  FROM {out}_c WHERE (type = 'text' AND NOT _container AND n_runs > 0) OR type IN ('event', 'image')),
{out}_l AS (SELECT *, last_value(_list_tag IGNORE NULLS) OVER (PARTITION BY page_id, list_depth ORDER BY k1, k2, k3
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _parent_list FROM {out}_f),
{out}_st AS (SELECT page_id, type, k1, k2, k3, full_text, n_runs, bold_text, markup, runs, img_url, alt,
    CASE WHEN type = 'text' THEN CASE WHEN seg_tag = 'li' THEN CASE WHEN coalesce(_parent_list = 'ol', false)
      THEN 'List Number' ELSE 'List Bullet' END WHEN seg_tag IN ('h1', 'h2', 'h3') THEN 'Heading 3'
      WHEN seg_tag IN ('h4', 'h5', 'h6') THEN 'Heading 4' ELSE 'Normal' END END AS style
  FROM {out}_l WHERE type <> 'event'),
{out}_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, full_text ORDER BY k1, k2, k3) AS _r
  FROM {out}_st) WHERE type <> 'text' OR _r = 1),
{out} AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k1, k2, k3) - 1 AS INTEGER) AS idx,
    type, style, full_text, markup, runs, img_url, alt, n_runs, bold_text FROM {out}_d)"""


def html_items_ctes(src: str = "pages", include_images: bool = False, strip_tags=None, root: str = "auto") -> str:
    return ",\n".join([tokens_ctes(src), strip_ctes("tok", H.STRIP_TAGS if strip_tags is None else strip_tags),
                       root_ctes("strip", root), segment_ctes("root"), items_ctes("seg", include_images)])


def sql_html_tokens() -> str:
    return f"WITH {tokens_ctes()} SELECT page_id, pos, kind, tag, tk FROM tok"


def sql_html_strip() -> str:
    return f"WITH {tokens_ctes()}, {strip_ctes('tok', H.STRIP_TAGS)} SELECT page_id, pos, kind, tag FROM strip"


def sql_html_root() -> str:
    return (f"WITH {tokens_ctes()}, {strip_ctes('tok', H.STRIP_TAGS)}, {root_ctes('strip')} "
            f"SELECT page_id, pos, kind, tag FROM root")


def sql_page_items() -> str:
    return f"WITH {html_items_ctes()} SELECT page_id, idx, type, style, full_text, img_url, alt, n_runs, bold_text FROM items"


def sql_html_runs() -> str:
    # runs are rebuilt from the part rows of the item pipeline
    return f"""WITH {html_items_ctes()},
runs AS (SELECT page_id, part_pos, pos, text, bold, italic FROM items_r1 WHERE _is_run AND text <> '')
SELECT i.page_id, i.idx, CAST(row_number() OVER (PARTITION BY i.page_id, i.idx ORDER BY r.pos) - 1 AS INTEGER) AS run_no,
  r.text, r.bold, r.italic
FROM (SELECT page_id, k1, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k1, k2, k3) - 1 AS INTEGER) AS idx, type
      FROM items_d) i
JOIN runs r ON r.page_id = i.page_id AND r.part_pos = i.k1 WHERE i.type = 'text'"""


def extract_ctes(items: str, urls_sql: str, start, stop, remove, out: str = "ext") -> str:
    rm = " AND lower(full_text) NOT IN " + lits([r.lower() for r in remove]) if remove else ""
    return f"""{bounds_cte(items, start, stop, out + '_b')},
{out}_k AS (SELECT page_id, idx, type, style, full_text, markup, img_url, alt, runs FROM {out}_b WHERE slice_start IS NOT NULL AND {KEEP}{rm}),
{out}_s AS (SELECT DISTINCT b.page_id, {1 << 30} AS idx, 'text' AS type, 'Normal' AS style,
    {lit(SOURCE_PREFIX)} || u.url AS full_text, NULL::VARCHAR AS markup, NULL::VARCHAR AS img_url, NULL::VARCHAR AS alt, NULL AS runs
  FROM {out}_b b JOIN ({urls_sql}) u ON u.page_id = b.page_id WHERE b.slice_start IS NOT NULL AND u.url IS NOT NULL AND u.url <> ''),
{out}_u AS (SELECT * FROM {out}_k UNION ALL SELECT * FROM {out}_s),
{out} AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS idx,
    type, style, full_text, markup, img_url, alt, runs FROM {out}_u)"""


def sql_scrape_page() -> str:
    return f"""WITH {html_items_ctes()}, {extract_ctes('items', 'SELECT page_id, url FROM pages', Q.PAGE_START, Q.PAGE_STOP, [])}
SELECT page_id, idx, style, full_text FROM ext"""


def anchors_ctes(src: str, out: str = "anc") -> str:
    void = lits(VOID_TAGS)
    return f"""{out}_0 AS (SELECT *, sum(CASE WHEN kind = 'open' AND tag NOT IN {void} THEN 1 WHEN kind = 'close' AND tag NOT IN {void} THEN -1 ELSE 0 END) OVER {WRUN} AS _D,
    sum(CASE WHEN kind = 'open' AND tag = 'a' THEN 1 ELSE 0 END) OVER {WRUN} AS _na,
    sum(CASE WHEN kind = 'open' AND tag = 'a' THEN 1 WHEN kind = 'close' AND tag = 'a' THEN -1 ELSE 0 END) OVER {WRUN} AS _oa
  FROM {src}),
{out}_0a AS (SELECT *, _oa - least(0, min(_oa) OVER {WRUN}) AS _ina FROM {out}_0),
{out}_1 AS (SELECT page_id, pos, kind, tag, base_url, _na,
    CASE WHEN kind = 'open' THEN CASE WHEN tag = 'a' THEN _D - 1 ELSE _D END END AS _key,
    CASE WHEN kind = 'text' THEN {py_strip(decode('tk'))} END AS _text,
    CASE WHEN kind = 'open' AND tag = 'a' AND {has_attr('tk', 'href')} THEN {py_strip(decode(attr('tk', 'href')))} END AS href
  FROM {out}_0a WHERE (kind = 'open' AND tag NOT IN {void}) OR (kind = 'text' AND _ina > 0 AND _na > 0)),
{out}_2 AS (SELECT *, last_value(CASE WHEN tag <> 'a' THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id, _key ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _parent FROM {out}_1),
{out}_t AS (SELECT page_id, _na, string_agg(_text, ' ' ORDER BY pos) AS title FROM {out}_1
  WHERE kind = 'text' AND _text <> '' GROUP BY page_id, _na),
{out} AS (SELECT a.page_id, a.pos, a.href, a.base_url, coalesce(t.title, '') AS text
  FROM {out}_2 a LEFT JOIN {out}_t t ON t.page_id = a.page_id AND t._na = a._na
  WHERE a.kind = 'open' AND a.tag = 'a' AND a.href IS NOT NULL AND a._parent = 'li')"""


def links_ctes(anchors: str, cap, out: str = "lnk") -> str:
    capf = f"WHERE link_no <= greatest(1, {int(cap)})" if cap is not None else ""
    first = "CASE WHEN text = '' THEN url ELSE text END"
    stripped = py_strip(f"ltrim({first}, {lit(TITLE_LSTRIP)})")
    return f"""{out}_0 AS (SELECT * FROM {anchors} WHERE href <> '' AND NOT starts_with(href, '#')
    AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, 'mailto:')),
{resolve_cte(out + '_1', out + '_0', 'base_url', 'href', '_res')},
{out}_2 AS (SELECT *, {defrag('_res')} AS url FROM {out}_1),
{out}_3 AS (SELECT *, {norm_key('url')} AS norm_url FROM {out}_2 WHERE lower({netloc('url')}) = lower({netloc('base_url')})),
{out}_4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, norm_url ORDER BY pos) AS _r FROM {out}_3) WHERE _r = 1),
{out}_5 AS (SELECT *, CASE WHEN {stripped} = '' THEN url ELSE {stripped} END AS title FROM {out}_4),
{out}_6 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS link_no FROM {out}_5
  WHERE lower(title) NOT IN {lits(RESERVED_TITLES)} AND norm_url <> {norm_key('base_url')}),
{out} AS (SELECT page_id, CAST(link_no AS INTEGER) AS link_no, title, url, norm_url, {slug('url')} AS slug FROM {out}_6 {capf})"""


NAV_KEPT_CTES = (f"{tokens_ctes()}, {strip_ctes('tok', Q.NAV_KEPT)}, {root_ctes('strip', 'body')}, "
                 f"{anchors_ctes('root')}")


def sql_toc_links() -> str:
    return f"WITH {NAV_KEPT_CTES} SELECT page_id, pos, href, text FROM anc"


def sql_detect_chapters() -> str:
    return f"WITH {NAV_KEPT_CTES}, {links_ctes('anc', Q.CHAPTER_CAP)} SELECT * FROM lnk"


def sql_link_cap() -> str:
    return f"WITH {NAV_KEPT_CTES}, {links_ctes('anc', Q.PAGE_LINK_CAP)} SELECT * FROM lnk"


def sql_link_report() -> str:
    cap = Q.PAGE_LINK_CAP
    return f"""WITH {NAV_KEPT_CTES}, {links_ctes('anc', None)}
SELECT page_id, count(*) AS links_found, least(count(*), greatest(1, {cap})) AS links_kept,
  count(*) > greatest(1, {cap}) AS cap_reached FROM lnk GROUP BY page_id"""


def sql_page_report() -> str:
    return f"""WITH {lines_cte()}, {bounds_cte('lines', Q.LINE_START, Q.LINE_STOP)},
per AS (SELECT page_id AS doc_id, count(*) AS items_parsed, count(*) FILTER (WHERE {KEEP}) AS items_sliced,
  count(*) FILTER (WHERE {KEEP} AND {REMOVED}) AS items_removed, count(*) FILTER (WHERE {KEEP} AND NOT {REMOVED}) AS items_kept,
  CAST(bool_and(slice_start IS NULL) AS INTEGER) AS no_start, CAST(bool_and(slice_start IS NOT NULL AND slice_stop IS NULL) AS INTEGER) AS no_stop
  FROM bounds GROUP BY page_id)
SELECT doc_id, sum(items_parsed) AS items_parsed, sum(items_sliced) AS items_sliced, sum(items_removed) AS items_removed,
  sum(items_kept) AS items_kept, sum(no_start) AS no_start, sum(no_stop) AS no_stop FROM per GROUP BY ROLLUP (doc_id)"""


def config_books_ctes() -> str:
    values = ", ".join(f"({lit(t)}, {lit(g)}, {lit(f)})" for t, g, f in Q.TEMPLATES)
    folders = ", ".join(f"({lit(c)}, {lit(f)})" for c, f in Q.FOLDERS)
    langs = "[" + ", ".join(lit(x) for x in Q.LANGUAGES) + "]"
    return f"""books AS (SELECT page_id AS book_id, CASE WHEN length(url) % 2 = 0 THEN 'main' ELSE 'other' END AS book_type,
  {langs}[length(url) % 3 + 1] AS language, CASE WHEN starts_with(url, 'https') THEN 'a' ELSE 'b' END AS config_id FROM pages),
tpl(book_type, language, file) AS (VALUES {values}), folders(config_id, folder) AS (VALUES {folders}),
paths AS (SELECT book_id, CASE WHEN file IS NULL THEN NULL WHEN folder = '' THEN file ELSE folder || '/' || file END AS template
  FROM books b LEFT JOIN tpl t ON t.book_type = b.book_type AND t.language = lower(b.language) LEFT JOIN folders USING (config_id))"""


def sql_template_lookup() -> str:
    return f"WITH {config_books_ctes()} SELECT * FROM paths"


def sql_style_fallback() -> str:
    styles = ", ".join(f"({lit(t)}, [{', '.join(lit(x) for x in xs)}])" for t, xs in Q.STYLES)
    return f"""WITH {html_items_ctes()}, {config_books_ctes()}, styles(template, has) AS (VALUES {styles}),
j AS (SELECT page_id, idx, p.template, style, full_text, coalesce(has, []::VARCHAR[]) AS has FROM items
  JOIN paths p ON p.book_id = page_id LEFT JOIN styles s ON s.template = p.template),
u AS (SELECT *, CASE WHEN list_contains(has, style) THEN style WHEN list_contains(has, 'List Bullet') THEN 'List Bullet'
  WHEN list_contains(has, 'List Paragraph') THEN 'List Paragraph' ELSE 'Normal' END AS used_style FROM j)
SELECT page_id, idx, template, style, used_style, starts_with(style, 'List Bullet') AND NOT starts_with(used_style, 'List Bullet') AS bullet_indent,
  CASE WHEN starts_with(style, 'List Bullet') AND NOT starts_with(used_style, 'List Bullet') THEN '• ' || full_text ELSE full_text END AS text FROM u"""


ORACLE = {
    "page_report": sql_page_report,
    "template_lookup": sql_template_lookup,
    "style_fallback": sql_style_fallback,
    "lines_slice": sql_lines_slice,
    "lines_bounds": sql_lines_bounds,
    "lines_remove_text": sql_lines_remove_text,
    "lines_remove_table": sql_lines_remove_table,
    "lines_source": sql_lines_source,
    "lines_dedup": sql_lines_dedup,
    "turns_slice": sql_turns_slice,
    "url_parts": sql_url_parts,
    "url_valid": sql_url_valid,
    "url_resolve": sql_url_resolve,
    "url_spans": sql_url_spans,
    "manifest": sql_manifest,
    "html_tokens": sql_html_tokens,
    "html_strip": sql_html_strip,
    "html_root": sql_html_root,
    "page_items": sql_page_items,
    "html_runs": sql_html_runs,
    "scrape_page": sql_scrape_page,
    "toc_links": sql_toc_links,
    "detect_chapters": sql_detect_chapters,
    "link_cap": sql_link_cap,
    "link_report": sql_link_report,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}


# ------------------------------------------------------------------ derived site: J/B/S/A
def bookmark(index: str, title: str) -> str:
    safe = f"regexp_replace(regexp_replace(regexp_replace({title}, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"'ch_' || CAST({index} AS VARCHAR) || '_' || substr({safe}, 1, 30)"


def numbered(n1: str, n2: str, n3: str, title: str) -> str:
    return (f"CASE WHEN {n2} = 0 THEN CAST({n1} AS VARCHAR) || '. ' || {title} "
            f"WHEN {n3} = 0 THEN CAST({n1} AS VARCHAR) || '.' || CAST({n2} AS VARCHAR) || ' ' || {title} "
            f"ELSE CAST({n1} AS VARCHAR) || '.' || CAST({n2} AS VARCHAR) || '.' || CAST({n3} AS VARCHAR) || ' ' || {title} END")


SITE_ITEMS = f"{SITE_SQL}, {html_items_ctes('site', include_images=True)}"
SITE_LINKS = f"{SITE_ITEMS}, {anchors_ctes('root')}, {links_ctes('anc', SITE_CONFIG['max_chapters'])}"
ALL_SITE_LINKS = f"{SITE_ITEMS}, {anchors_ctes('root')}, {links_ctes('anc', None)}"


def _level(n: int, parent: str) -> str:
    num = {1: "n1", 2: "n2", 3: "n3"}[n]
    part = {1: "p.book_id", 2: "p.book_id, p.n1", 3: "p.book_id, p.n1, p.n2"}[n]
    keep = "" if n == 1 else "AND starts_with(l.slug, p.slug || '-')"
    cols = {1: "CAST(row_number() OVER (PARTITION BY p.book_id ORDER BY l.link_no) AS INTEGER) AS n1, 0 AS n2, 0 AS n3",
            2: "p.n1, CAST(row_number() OVER (PARTITION BY p.book_id, p.n1 ORDER BY l.link_no) AS INTEGER) AS n2, 0 AS n3",
            3: "p.n1, p.n2, CAST(row_number() OVER (PARTITION BY p.book_id, p.n1, p.n2 ORDER BY l.link_no) AS INTEGER) AS n3"}[n]
    del num, part
    return f"""lv{n} AS (SELECT p.book_id, p.config_id, p.cap, p.depth, {cols}, {n} AS level, l.title, l.url, l.slug, k.page_id
  FROM {parent} p JOIN lnk l ON l.page_id = p.page_id AND l.link_no <= p.cap AND p.depth >= {n} {keep}
  LEFT JOIN keys k ON k.page_key = l.norm_url WHERE p.page_id IS NOT NULL)"""


ONE_SITE_CONFIG = f"""site_cfg(config_id, cap, depth) AS (VALUES ('site', {SITE_CONFIG['max_chapters']}, {SITE_CONFIG['max_depth']})),
cfg_books AS (SELECT *, config_id AS own FROM site_books)"""
_SECTIONS = f"""keys AS (SELECT {norm_key(defrag('url'))} AS page_key, min(page_id) AS page_id FROM site GROUP BY 1),
roots AS (SELECT b.book_id, b.own AS config_id, b.url, b.title, k.page_id AS root_page_id FROM cfg_books b
  LEFT JOIN keys k ON k.page_key = {norm_key(defrag('b.url'))}),
lv0 AS (SELECT book_id, config_id, cap, depth, 0 AS n1, 0 AS n2, 0 AS n3, root_page_id AS page_id, {slug('url')} AS slug
  FROM roots JOIN site_cfg USING (config_id) WHERE root_page_id IS NOT NULL),
{_level(1, 'lv0')},
{_level(2, 'lv1')},
{_level(3, 'lv2')},
sec0 AS (SELECT * FROM lv1 UNION ALL SELECT * FROM lv2 UNION ALL SELECT * FROM lv3),
per_ch AS (SELECT book_id, n1, coalesce(sum(count(*)) OVER (PARTITION BY book_id ORDER BY n1
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before FROM sec0 GROUP BY book_id, n1),
sections AS (SELECT s.*, CASE WHEN s.page_id IS NULL THEN 'missing' ELSE 'ok' END AS status,
  {numbered('s.n1', 's.n2', 's.n3', 's.title')} AS number_title,
  c._before + row_number() OVER (PARTITION BY s.book_id, s.n1 ORDER BY s.n2, s.n3) AS bookmark_id
  FROM sec0 s JOIN per_ch c ON c.book_id = s.book_id AND c.n1 = s.n1)"""
SECTIONS = f"{ALL_SITE_LINKS}, {ONE_SITE_CONFIG}, {_SECTIONS}"


def sql_site_items() -> str:
    return f"WITH {SITE_ITEMS} SELECT page_id, idx, type, style, full_text, img_url, alt, n_runs, bold_text FROM items"


def sql_site_links() -> str:
    return f"WITH {SITE_LINKS} SELECT * FROM lnk"


def sql_expand_site() -> str:
    return f"""WITH {SECTIONS}
SELECT book_id, n1, n2, n3, level, title, url, page_id, status, number_title, bookmark_id,
  {bookmark('CASE WHEN level = 1 THEN n1 ELSE bookmark_id END', 'title')} AS bookmark FROM sections"""


def _lines_sql() -> str:
    c = SITE_CONFIG
    return f"""{SECTIONS},
{extract_ctes('items', 'SELECT page_id, url FROM site', c['start_markers'], c['stop_markers'], c['remove_text'], 'ext1')},
ext AS (SELECT *, 'site' AS config_id FROM ext1), {_assembled_sql()}"""


def _assembled_sql() -> str:
    """Lines of the books in ``cfg_books`` from ``sections``, ``roots`` and ``ext`` (content by page and config)."""
    line = ("book_id, n1, n2, n3, rank, idx, kind, style, text, markup, img_url, font_pt, alt, runs")
    return f"""b AS (SELECT book_id, title AS _book_title FROM cfg_books JOIN site_cfg ON site_cfg.config_id = own),
secpages AS (SELECT book_id, config_id, root_page_id AS page_id, 0 AS n1, 0 AS n2, 0 AS n3 FROM roots JOIN site_cfg USING (config_id) WHERE root_page_id IS NOT NULL
  UNION ALL SELECT book_id, config_id, page_id, n1, n2, n3 FROM sections WHERE page_id IS NOT NULL),
body AS (SELECT s.book_id, s.n1, s.n2, s.n3, 1 AS rank, e.idx, e.type AS kind, e.style,
  CASE WHEN e.type = 'image' THEN NULL ELSE e.full_text END AS text, e.markup, e.img_url,
  CASE WHEN s.n1 >= {BIG_FONT_FROM_CHAPTER} THEN {BIG_FONT_PT} END AS font_pt, e.alt, e.runs
  FROM secpages s JOIN ext e ON e.page_id = s.page_id AND e.config_id = s.config_id),
has_lines AS (SELECT DISTINCT s.book_id, s.n1, s.n2, s.n3 FROM secpages s WHERE (s.page_id, s.config_id) IN (SELECT (page_id, config_id) FROM ext)),
child_of AS (SELECT DISTINCT book_id, n1, CASE WHEN level = 3 THEN n2 ELSE 0 END AS n2, 0 AS n3 FROM sections WHERE level >= 2),
ph AS (SELECT s.book_id, s.n1, s.n2, s.n3, 2 AS rank, 0 AS idx, 'placeholder' AS kind, 'Normal' AS style,
  CASE WHEN s.level = 1 THEN {lit(PLACEHOLDER[1])} WHEN s.level = 2 THEN {lit(PLACEHOLDER[2])} ELSE {lit(PLACEHOLDER[3])} END AS text,
  NULL AS markup, NULL AS img_url, NULL AS font_pt, NULL AS alt, NULL AS runs FROM sections s
  WHERE NOT EXISTS (SELECT 1 FROM has_lines h WHERE h.book_id = s.book_id AND h.n1 = s.n1 AND h.n2 = s.n2 AND h.n3 = s.n3)
    AND NOT EXISTS (SELECT 1 FROM child_of c WHERE c.book_id = s.book_id AND c.n1 = s.n1 AND c.n2 = s.n2 AND c.n3 = s.n3)),
allrows AS (
  SELECT book_id, -1 AS n1, 0 AS n2, 0 AS n3, 0 AS rank, 0 AS idx, 'title' AS kind, 'Title' AS style, {lit(TOC_TITLE)} AS text, NULL AS markup, NULL AS img_url, NULL AS font_pt, NULL AS alt, NULL AS runs FROM b
  UNION ALL SELECT book_id, -1, 0, 0, 1, 0, 'toc_field', NULL, {lit('TOC \\o "1-3" \\h \\z \\u')}, NULL, NULL, NULL, NULL, NULL FROM b
  UNION ALL SELECT book_id, -1, {END}, {END}, 0, 0, 'break', NULL, '', NULL, NULL, NULL, NULL, NULL FROM b
  UNION ALL SELECT book_id, 0, 0, 0, 0, 0, 'heading', 'Heading 1', {lit(INTRO_TITLE)}, NULL, NULL, NULL, NULL, NULL FROM b
  UNION ALL SELECT book_id, 0, {END}, {END}, 0, 0, 'break', NULL, '', NULL, NULL, NULL, NULL, NULL FROM b
  UNION ALL SELECT {line} FROM body
  UNION ALL SELECT book_id, n1, n2, n3, 0, 0, 'heading', 'Heading ' || CAST(level AS VARCHAR),
    {numbered('n1', 'n2', 'n3', 'title')}, NULL, NULL, NULL, NULL, NULL FROM sections
  UNION ALL SELECT {line} FROM ph
  UNION ALL SELECT book_id, n1, {END}, {END}, 0, 0, 'break', NULL, '', NULL, NULL, NULL, NULL, NULL FROM sections WHERE level = 1),
lines AS (SELECT a.book_id, a.n1, a.n2, a.n3,
  CAST(row_number() OVER (PARTITION BY a.book_id, a.n1, a.n2, a.n3 ORDER BY a.rank, a.idx) AS INTEGER) AS line_no,
  a.kind, a.style, replace(replace(a.text, 'XXX1', b._book_title), 'HHH1', b._book_title) AS text,
  replace(replace(a.markup, 'XXX1', b._book_title), 'HHH1', b._book_title) AS markup,
  a.img_url, CAST(a.font_pt AS INTEGER) AS font_pt, a.alt,
  list_transform(a.runs, lambda r: {{'text': replace(replace(r.text, 'XXX1', b._book_title), 'HHH1', b._book_title), 'bold': r.bold, 'italic': r.italic}}) AS runs
  FROM allrows a JOIN b ON b.book_id = a.book_id)"""


def sql_book_lines() -> str:
    return f"WITH {_lines_sql()} SELECT * EXCLUDE (runs) FROM lines"


def _md(kind: str, style: str, text: str, img: str) -> str:
    line = md_line_start(text)
    for char, code in MD_TARGET:
        img = f"replace({img}, {lit(char)}, {lit(code)})"
    label = md_escape("coalesce(alt, 'image')")
    return (f"CASE WHEN {kind} = 'title' THEN '# ' || {text} WHEN {kind} = 'toc_field' THEN '[TOC]' "
            f"WHEN {kind} = 'break' THEN '---' WHEN {kind} = 'image' THEN '![' || {label} || '](' || {img} || ')' "
            f"WHEN starts_with({style}, 'Heading ') THEN repeat('#', CAST(substr({style}, 9, 2) AS INTEGER) + 1) || ' ' || {text} "
            f"WHEN {style} = 'List Bullet' THEN '- ' || {line} WHEN {style} = 'List Number' THEN '1. ' || {line} "
            f"ELSE {line} END")


def sql_render_book() -> str:
    return f"""WITH {_lines_sql()}
SELECT book_id, n1, n2, string_agg({_md('kind', 'style', f"coalesce(markup, {md_escape('text')})", 'img_url')}, chr(10) ORDER BY n3, line_no) AS markdown
FROM lines GROUP BY book_id, n1, n2"""


def sql_book_report() -> str:
    return f"""WITH {SECTIONS}
SELECT book_id, level, count(*) AS sections, count(*) FILTER (WHERE status = 'missing') AS missing
FROM sections GROUP BY ROLLUP (book_id, level)"""


def sql_image_lookup() -> str:
    return f"""WITH {SITE_ITEMS}
SELECT page_id, idx, img_url, alt, octet_length(encode(img_url)) AS n_bytes FROM items WHERE type = 'image' AND length(img_url) % 2 = 0"""


def _paragraph_ctes() -> str:
    tpl = ", ".join(f"({lit(t)}, {lit(g)}, {lit(f)})" for t, g, f in Q.SITE_TEMPLATES)
    styles = ", ".join(f"({lit(t)}, [{', '.join(lit(x) for x in xs)}])" for t, xs in Q.SITE_STYLES)
    return f"""{_lines_sql()}, tpl(book_type, language, file) AS (VALUES {tpl}), styles(template, has) AS (VALUES {styles}),
paths AS (SELECT book_id, b.title, b.url, {lit(Q.SITE_FOLDER + '/')} || file AS template FROM site_books b
  LEFT JOIN tpl t ON t.book_type = b.book_type AND t.language = lower(b.language)),
j AS (SELECT l.*, p.template, coalesce(has, []::VARCHAR[]) AS has FROM lines l JOIN paths p USING (book_id) LEFT JOIN styles s ON s.template = p.template),
u AS (SELECT *, CASE WHEN kind <> 'text' OR list_contains(has, style) THEN style WHEN list_contains(has, 'List Bullet') THEN 'List Bullet'
  WHEN list_contains(has, 'List Paragraph') THEN 'List Paragraph' ELSE 'Normal' END AS used_style FROM j),
v AS (SELECT *, kind = 'text' AND starts_with(style, 'List Bullet') AND NOT starts_with(used_style, 'List Bullet') AS bullet_indent FROM u),
par AS (SELECT book_id, n1, n2, n3, line_no, kind, template, style, used_style, bullet_indent,
    CASE WHEN bullet_indent THEN '• ' || text ELSE text END AS text, img_url, alt,
    CASE WHEN kind = 'image' THEN octet_length(encode(img_url)) END AS image_bytes, font_pt, runs
  FROM v WHERE kind <> 'image' OR length(img_url) % 2 = 0
  UNION ALL SELECT book_id, -2, 0, 0, 1, 'header', template, NULL, NULL, false, coalesce(CASE WHEN title <> '' THEN title END, {lit(Q.DEFAULT_HEADER)}), NULL, NULL, NULL, NULL, NULL FROM paths
  UNION ALL SELECT book_id, -2, 0, 0, 2, 'footer', template, NULL, NULL, false, coalesce(CASE WHEN url <> '' THEN url END, {lit(Q.DEFAULT_FOOTER)}), NULL, NULL, NULL, NULL, NULL FROM paths)"""


def sql_book_paragraphs() -> str:
    return f"WITH {_paragraph_ctes()} SELECT * EXCLUDE (runs) FROM par"


def sql_book_runs() -> str:
    re = lit(URL_SPAN_RE)
    return f"""WITH {_paragraph_ctes()},
t AS (SELECT *, runs IS NOT NULL AS own, coalesce(runs, [{{'text': text, 'bold': false, 'italic': false}}]) AS rr FROM par WHERE kind = 'text'),
r AS (SELECT book_id, n1, n2, n3, line_no, bullet_indent, own, unnest(rr) AS x, generate_subscripts(rr, 1) AS i FROM t),
w AS (SELECT *, CASE WHEN i = 1 AND own AND bullet_indent THEN '• ' ELSE '' END || x.text AS body FROM r),
q AS (SELECT *, regexp_split_to_array(body, {re}) AS parts, regexp_extract_all(body, {re}, 0) AS urls FROM w),
z AS (SELECT book_id, n1, n2, n3, line_no, i, 0 AS k, ' ' AS text, false AS bold, false AS italic, false AS is_url FROM q WHERE i > 1
  UNION ALL SELECT book_id, n1, n2, n3, line_no, i, 2 * generate_subscripts(parts, 1), unnest(parts), x.bold, x.italic, false FROM q
  UNION ALL SELECT book_id, n1, n2, n3, line_no, i, 2 * generate_subscripts(urls, 1) + 1, unnest(urls), x.bold, x.italic, true FROM q)
SELECT book_id, n1, n2, n3, line_no, CAST(row_number() OVER (PARTITION BY book_id, n1, n2, n3, line_no ORDER BY i, k) - 1 AS INTEGER) AS piece_no,
  text, bold, italic, is_url FROM z WHERE text <> ''"""


def sql_run_report() -> str:
    return f"""WITH {_lines_sql()},
per AS (SELECT page_id, max(CAST(slice_start IS NULL AS INTEGER)) AS no_start, max(CAST(slice_start IS NOT NULL AND slice_stop IS NULL AS INTEGER)) AS no_stop,
  count(*) FILTER (WHERE {KEEP} AND lower(full_text) NOT IN {lits([x.lower() for x in SITE_CONFIG['remove_text']])}) AS kept,
  count(*) FILTER (WHERE {KEEP} AND lower(full_text) IN {lits([x.lower() for x in SITE_CONFIG['remove_text']])}) AS removed FROM ext1_b GROUP BY page_id),
found AS (SELECT page_id, max(link_no) AS n FROM lnk GROUP BY page_id),
counts AS (SELECT book_id, level, 1 AS sections, CAST(status = 'missing' AS INTEGER) AS missing, no_start, no_stop, kept, removed,
    CASE WHEN level < depth THEN greatest(0, coalesce(n, 0) - cap) END AS links_cut, 0 AS images_failed
  FROM sections LEFT JOIN per USING (page_id) LEFT JOIN found USING (page_id)
  UNION ALL SELECT book_id, CASE WHEN n2 = 0 THEN 1 WHEN n3 = 0 THEN 2 ELSE 3 END, 0, 0, 0, 0, 0, 0, 0, 1 FROM lines
  WHERE kind = 'image' AND n1 > 0 AND length(img_url) % 2 = 1)
SELECT book_id, level, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in
  ('sections', 'missing', 'no_start', 'no_stop', 'kept', 'removed', 'links_cut', 'images_failed'))}
FROM counts GROUP BY ROLLUP (book_id, level)"""


def sql_config_book_lines() -> str:
    known = {k: c for k, c in Q.CONFIGS.items() if k != "odd"}
    cfg = ", ".join(f"({lit(k)}, {c.max_chapters}, {c.max_depth})" for k, c in known.items())
    plain = "plain AS (SELECT * EXCLUDE (idx), CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS idx FROM items WHERE type = 'text')"
    exts = ", ".join(extract_ctes("items" if c.include_images else "plain", "SELECT page_id, url FROM site", c.start_markers, c.stop_markers,
                                  c.remove_text, f"ext_{k}") for k, c in known.items())
    every = " UNION ALL BY NAME ".join(f"SELECT *, {lit(k)} AS config_id FROM ext_{k}" for k in known)
    return f"""WITH {ALL_SITE_LINKS}, site_cfg(config_id, cap, depth) AS (VALUES {cfg}),
cfg_books AS (SELECT *, {Q.BOOK_CONFIGS}[book_id + 1] AS own FROM site_books), {_SECTIONS}, {plain}, {exts}, ext AS ({every}), {_assembled_sql()}
SELECT * EXCLUDE (runs) FROM lines"""


def _config_ctes() -> str:
    return """c AS (SELECT item_id, CAST(item_id AS VARCHAR) AS config_id, string_split(text, ' ') AS w, string_split(text, chr(10))[1] AS line
  FROM benchmark WHERE item_id % 10 <> 9)"""


def sql_config_markers() -> str:
    return f"""WITH {_config_ctes()},
l AS (SELECT config_id, 'start_markers' AS kind, list_filter([w[1]], lambda x: x IS NOT NULL) AS m FROM c
  UNION ALL SELECT config_id, 'stop_markers', list_filter([w[2], w[3]], lambda x: x IS NOT NULL) FROM c UNION ALL SELECT config_id, 'remove_text', [line] FROM c)
SELECT config_id, kind, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS marker FROM l"""


def sql_config_limits() -> str:
    return f"""WITH {_config_ctes()}
SELECT config_id, CASE WHEN item_id % 8 = 0 THEN NULL WHEN item_id % 2 = 0 THEN 'ol' ELSE 'li' END AS selector,
  CAST(CASE WHEN item_id % 3 = 0 THEN greatest(1, item_id % 50) ELSE 100 END AS INTEGER) AS max_chapters,
  CAST(CASE WHEN item_id % 4 = 0 THEN least(3, greatest(1, item_id % 6)) ELSE 1 END AS INTEGER) AS max_depth, false AS include_images, 1 AS n_removed FROM c"""


def sql_manifest_books() -> str:
    return f"""WITH {SECTIONS}
SELECT book_id, NULL AS reason, count(*) AS sections FROM sections GROUP BY book_id
UNION ALL SELECT book_id + 100, CASE WHEN book_id % 2 = 0 THEN 'parent_dir' ELSE 'scheme' END, NULL FROM site_books
UNION ALL SELECT NULL, 'corrupt', NULL FROM site_books"""


def sql_toc_preview() -> str:
    return f"""WITH {SECTIONS}
SELECT book_id, n1, title, greatest(_total - 10, 0) AS more FROM (
  SELECT book_id, n1, title, row_number() OVER (PARTITION BY book_id ORDER BY n1) AS _rn,
         count(*) OVER (PARTITION BY book_id) AS _total FROM sections WHERE level = 1) WHERE _rn <= 10"""


def sql_toc() -> str:
    return f"""WITH {_lines_sql()}
SELECT book_id, n1, n2, n3, line_no,
  CASE WHEN style = 'Heading 1' THEN 1 WHEN style = 'Heading 2' THEN 2 ELSE 3 END AS toc_level, text
FROM lines WHERE kind = 'heading' OR style = 'Heading 3'"""


def sql_header_footer() -> str:
    title = collapse(decode(f"regexp_extract(html, {lit(Q.TITLE_RE)}, 1)"))
    return f"""SELECT page_id AS book_id,
  coalesce(CASE WHEN {title} <> '' THEN {title} END, {lit(Q.DEFAULT_HEADER)}) AS header,
  coalesce(CASE WHEN url <> '' THEN url END, {lit(Q.DEFAULT_FOOTER)}) AS footer
FROM pages"""


ORACLE.update({
    "toc": sql_toc,
    "header_footer": sql_header_footer,
    "config_markers": sql_config_markers,
    "config_limits": sql_config_limits,
    "config_book_lines": sql_config_book_lines,
    "manifest_books": sql_manifest_books,
    "book_paragraphs": sql_book_paragraphs,
    "book_runs": sql_book_runs,
    "run_report": sql_run_report,
    "site_items": sql_site_items,
    "image_lookup": sql_image_lookup,
    "site_links": sql_site_links,
    "expand_site": sql_expand_site,
    "book_lines": sql_book_lines,
    "render_book": sql_render_book,
    "book_report": sql_book_report,
    "toc_preview": sql_toc_preview,
})
