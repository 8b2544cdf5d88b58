"""DuckDB SQL for the corpus queries that SQL can express: 3, 7, 9, 12 and 13.

The others decode, sketch, tokenise, learn or iterate; tests hold them against brute force,
round trips and held-out labels.
"""

from __future__ import annotations

from quire.llm import pii, queries, rules, url_filter

SPACE = r"[\x20\x09-\x0D]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- operator 3
def _host(u: str) -> str:
    return f"lower(regexp_extract(coalesce({u}, ''), '^(?s:.*?)://([^/?#]*)', 1))"


def _path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _canonical(u: str) -> str:
    host = f"regexp_replace({_host(u)}, '^(www\\.|m\\.)+', '')"
    path = f"regexp_replace({_path(u)}, '(/(index)?\\.html?|\\.html?|/)$', '')"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (f"array_to_string(list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT "
            f"regexp_matches(p, '^({url_filter.TRACKING})='))), '&')")
    return f"CASE WHEN contains({u}, '://') THEN 'https://' || {host} || {path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


def _rule(host: str, path: str, field: str) -> str:
    ranked = sorted(queries.URL_RULES, key=lambda r: -len(r.name))
    return "CASE " + " ".join(
        f"WHEN ({host} = {lit(r.host)} OR ends_with({host}, {lit('.' + r.host)})) AND starts_with({path}, {lit(r.path)}) THEN {lit(getattr(r, field))}"
        for r in ranked) + " END"


def sql_url_filter() -> str:
    tag = "array_to_string(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*[\"'']?canonical\\b')), '')"
    href = f"regexp_extract({tag}, '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    meta = "regexp_extract(html, '(?is)<meta\\b[^>]*http-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*url\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    return f"""WITH RECURSIVE found AS (SELECT url AS src, unnest([{href}, {meta}]) AS dst FROM pages WHERE url IS NOT NULL),
declared AS (SELECT src, CASE WHEN starts_with(dst, '/') AND NOT starts_with(dst, '//') THEN regexp_extract(src, '^[^/?#]*://[^/?#]*') || dst ELSE dst END AS dst
  FROM found WHERE dst <> ''),
usable AS (SELECT * FROM declared WHERE contains(src, '://') AND contains(dst, '://')),
links AS (SELECT * FROM usable UNION SELECT dst, {_canonical('dst')} FROM usable
  UNION SELECT DISTINCT url, {_canonical('url')} FROM pages WHERE contains(url, '://')),
both_ways AS (SELECT src AS a, dst AS b FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON other = a),
member AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
said AS (SELECT component, bool_or({_rule(_host('node'), _path('node'), 'verdict')} = 'allow') AS allows,
  bool_or({_rule(_host('node'), _path('node'), 'verdict')} = 'block') AS blocks FROM member GROUP BY component),
judged AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_rule(_host('url'), _path('url'), 'name')} AS rule,
  {_rule(_host('url'), _path('url'), 'verdict')} AS v, m.component, coalesce(blocks, false) AND NOT coalesce(allows, false) AS blocked
  FROM pages LEFT JOIN member m ON url = node LEFT JOIN said USING (component))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component,
  CASE WHEN v IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'default' END AS verdict_by FROM judged"""


# ---------------------------------------------------------------- operator 7
def sql_quality_rules() -> str:
    def over(a, b):
        return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END"
    ratios = {
        "n_words": "n_words::DOUBLE", "repeat_word_ratio": over("n_repeat_words", "n_words"), "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"), "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "upper_char_ratio": over("n_upper_chars", "word_chars"), "distinct_word_ratio": over("n_distinct_words", "n_words"),
        "stop_words_missing": f"CAST(n_words >= {rules.STOP_WORD_FROM} AND n_stop_words = 0 AS INTEGER)",
    }
    cases = []
    for name, low, high in rules.RULES:
        bad = [f"({ratios[name]}) < {low}"] * (low is not None) + [f"({ratios[name]}) > {high}"] * (high is not None)
        cases.append(f"CASE WHEN {' OR '.join(bad)} THEN {lit(name)} END")
    stops = "[" + ", ".join(lit(x) for x in rules.STOP_WORDS + [x.capitalize() for x in rules.STOP_WORDS]) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i:i + 4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM p WHERE len(w) > 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS x FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•‣·]'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_ellipsis_lines,
  length(t) - length(translate(t, {lit(rules.CAPITALS)}, '')) AS n_upper_chars,
  len(list_filter(w, lambda x: list_contains({stops}, x))) AS n_stop_words, len(list_distinct(w)) AS n_distinct_words
  FROM p LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS bad FROM m)
SELECT * EXCLUDE (bad), NOT base_failed AND len(bad) = 0 AS kept, array_to_string(bad, ',') AS broken FROM b"""


# ---------------------------------------------------------------- operator 9
# The base patterns as SQL's engine takes them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _spans(key: str, text: str, source: str) -> str:
    """(key, start, rank, finish, kind, value) of all passing base matches of ``text``."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[length({digits}) - i]::INTEGER "
            f"ELSE ({digits}[length({digits}) - i]::INTEGER * 2 - CASE WHEN {digits}[length({digits}) - i]::INTEGER > 4 THEN 9 ELSE 0 END) END)) % 10 = 0")
    passes = {
        "email": "true",
        "ip": "len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        p = lit(pattern)
        parts.append(f"""SELECT {key}, start, {rank} AS rank, start + length(value) AS finish, {lit(kind)} AS kind, value FROM (
  SELECT {key}, m[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT {key}, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS gaps FROM {source} WHERE regexp_matches({text}, {p}))))
  WHERE {passes[kind]}""")
    return " UNION ALL ".join(parts)


def sql_pii() -> str:
    terms = "list_filter(list_distinct(string_split_regex(lower({}), '[^\\pL\\pN]+')), lambda x: x <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans('r', 't', 'd')}),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM d),
l AS (SELECT *, r * 1000000 + no AS k, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM l0),
ls AS ({_spans('k', 'line', 'l')}),
-- distinct texts by id, as copies under one id are one document
el AS (SELECT l.* FROM l JOIN (SELECT min(r) AS r FROM d GROUP BY doc_id, t) o USING (r) WHERE k IN (SELECT k FROM ls)),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest({terms.format('line')}) AS term FROM l) GROUP BY term),
total AS (SELECT count(*) AS n FROM l WHERE regexp_matches(line, '[\\pL\\pN]')),
n_k AS (SELECT kind, count(DISTINCT k) AS n_k FROM ls WHERE k IN (SELECT k FROM el) GROUP BY kind),
chars AS (SELECT k, unnest(string_split(line, '')) AS c, unnest(range(length(line))) AS i FROM el),
masked AS (SELECT k, string_agg(CASE WHEN EXISTS (SELECT 1 FROM ls WHERE ls.k = chars.k AND i >= start AND i < finish) THEN ' ' ELSE c END, '' ORDER BY i) AS line FROM chars GROUP BY k),
near AS (SELECT k, unnest({terms.format('line')}) AS term FROM masked),
pairs AS (SELECT term, kind, count(DISTINCT k) AS n_tk, count(DISTINCT value) AS n_values FROM near JOIN ls USING (k) GROUP BY term, kind),
told AS (SELECT term, kind, ln(n::DOUBLE * n_tk / (n_t::DOUBLE * n_k)) / ln(n::DOUBLE / n_k) AS disclosure
  FROM pairs JOIN n_k USING (kind) JOIN n_t USING (term), total WHERE n_values >= {pii.SUPPORT} AND n > n_k),
revealing AS (SELECT * FROM told WHERE disclosure >= {pii.GENERALISE}),
hits AS (SELECT DISTINCT k, term FROM (SELECT DISTINCT k, kind FROM ls) JOIN revealing USING (kind) JOIN l USING (k) WHERE list_contains({terms.format('line')}, term)),
w0 AS (SELECT k, r, line_start, regexp_extract_all(line, '[\\pL\\pN]+') AS m, string_split_regex(line, '[\\pL\\pN]+') AS gaps FROM l WHERE k IN (SELECT k FROM hits)),
w AS (SELECT k, r, line_start, m[i] AS word, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM w0)),
tspans AS (SELECT r, line_start + start AS start, 4 AS rank, line_start + start + length(word) AS finish, 'term' AS kind, word AS value FROM w
  JOIN hits ON hits.k = w.k AND hits.term = lower(word)
  WHERE NOT EXISTS (SELECT 1 FROM ls WHERE ls.k = w.k AND ls.start < w.start + length(word) AND finish > w.start)),
every AS (SELECT * FROM s UNION ALL SELECT * FROM tspans),
per AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_term,
  string_agg(kind || ':' || start::BIGINT || ':' || finish::BIGINT, ',' ORDER BY start, rank) FILTER (kind <> 'term') AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || finish::BIGINT, ',' ORDER BY start, rank) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term FROM d LEFT JOIN per USING (r)"""


# ---------------------------------------------------------------- operator 12
def sql_ranked_search() -> str:
    def terms(table: str, key: str) -> str:
        low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return (f"SELECT r, {key}, unnest(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term "
                f"FROM (SELECT *, row_number() OVER () AS r FROM {table})")

    return f"""WITH tf AS (SELECT r, doc_id, term, count(*) AS tf FROM ({terms('documents', 'doc_id')}) GROUP BY r, doc_id, term),
item AS (SELECT DISTINCT r AS i, item_id, term FROM ({terms('benchmark', 'item_id')})),
doc AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM doc),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total
  WHERE term IN (SELECT term FROM item) GROUP BY term, n_docs),
impact AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_all)) AS x
  FROM tf JOIN weight USING (term) JOIN doc USING (r), total),
scored AS (SELECT i, item_id, r, doc_id, sum(w * x)::BIGINT AS score FROM item JOIN weight USING (term) JOIN impact USING (term) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


# ---------------------------------------------------------------- operator 13
def sql_fill_in_middle() -> str:
    def drawn(i: int) -> str:
        return f"CAST('0x' || substr(name, {8 * i + 1}, 8) AS BIGINT)"

    return f"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS name,
  regexp_extract_all(coalesce(text, ''), '{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+') AS units FROM documents),
placed AS (SELECT *, len(units) AS n, {drawn(0)} % (len(units) + 1) AS x, {drawn(1)} % (len(units) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {drawn(2)} % 100 >= 50 THEN 'plain'
       WHEN {drawn(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
  array_to_string(units[greatest(x, y) + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM parts"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": sql_url_filter(), "op7_quality_rules": sql_quality_rules(), "op9_pii": sql_pii(),
            "op12_ranked_search": sql_ranked_search(), "op13_fill_in_middle": sql_fill_in_middle()}
