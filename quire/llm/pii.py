"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base patterns find protected entities (email, ip, card, phone) with their places.  Terms that
give entities away are found from the corpus: with lines as contexts, N of them, n(t) holding
term t, n(k) holding an entity of kind k and n(t, k) both,

    disclosure(t, k) = PMI(t; k) / IC(k) = ln(N n(t, k) / (n(t) n(k))) / ln(N / n(k)),

which is 1 when t occurs with the kind only and 0 when it tells nothing.  A term counts only with
``SUPPORT`` different entity values of the kind beside it, so that copies of one text are no
evidence.  In lines with such an entity, terms of disclosure ``GENERALISE`` or more are replaced by
the kind's name and those of ``REMOVE`` or more are taken out.

All counts are over all lines of all documents: two-level aggregations before and after the
shuffle, one row per term and task.  Positions are those of code points.  No user function, no
Python: entity places come from the pieces that a split by the pattern leaves, term places from a
running sum over one line's pieces.

Defined cases: null text counts as empty and has no spans; repeated rows get equal spans; an empty
table gives no rows; rows without an id are judged like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

SUPPORT, GENERALISE, REMOVE = 5, 0.85, 0.95
KINDS = ["email", "ip", "card", "phone"]
TERM = "[\\p{L}\\p{N}]+"

# The base patterns; the last repeats are possessive, which loops where others
# recurse.  A match may begin at the last match's end or where the run of
# characters it begins with does; elsewhere it could only repeat a failure, and long runs would
# cost the square of their length.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a match that passes must hold; spares the others the full pattern.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
SPAN = "array<struct<start: int, rank: int, end: int, kind: string, value: string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a run of digits passes Luhn's check."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        part_ok = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part_ok)
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    """The kind's passing matches with their places, from the pieces between all matches."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    none = F.array().cast(SPAN)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one more piece than matches; the last has no match and ends the walk
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        ok = x["m"].isNotNull() & _passes(kind, x["m"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], F.array(span).cast(SPAN))).otherwise(acc["found"]).alias("found"))

    return F.when(_HINTS[kind](text), F.aggregate(steps, start, step)["found"]).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text without nulls, by start and then kind."""
    return F.array_sort(F.concat(*[_spans_of(k, text) for k in KINDS]))


def _terms(line: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(line), "[^\\p{L}\\p{N}]+")), lambda t: t != "")


def term_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term_key, n_t): lines of the whole corpus that hold the term of that hash."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    keys = lines.select(F.explode(F.transform(_terms(F.col("line")), lambda t: F.xxhash64(t))).alias("term_key"))
    return keys.groupBy("term_key").agg(F.count(F.lit(1)).alias("n_t"))


def count_lines(docs: DataFrame, text_col: str = "text") -> int:
    """Lines of the whole corpus that hold a term."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("[\\p{L}\\p{N}]")))
    return docs.agg(F.coalesce(F.sum(own), F.lit(0)).alias("n")).first()["n"]


def entity_lines(found: DataFrame) -> DataFrame:
    """(key, line_no, line_start, line, spans) of lines that hold an entity, of distinct texts by
    id; ``found`` has key, text and spans.  No entity holds a line break, so lines are searched
    alone."""
    split = found.filter(F.size("spans") > 0).dropDuplicates(["key"]).select("key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    return placed.withColumn("spans", base_spans(F.col("line"))).filter(F.size("spans") > 0)


def disclosures(lines: DataFrame, corpus: DataFrame, n_lines: int, support: int = SUPPORT) -> DataFrame:
    """(term, kind, disclosure) of all terms with enough different entity values beside them."""
    masked = F.aggregate("spans", F.col("line"), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]),
        F.substring(t, s["end"] + 1, F.length(t))))
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    of_kind = lines.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_k"))
    beside = lines.select(F.explode(_terms(masked)).alias("term"), "spans", kinds.alias("kinds"))
    together = beside.select("term", F.explode("kinds").alias("kind")).groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n_tk"))
    values = beside.select("term", F.explode("spans").alias("s")).select("term", "s.kind", "s.value").distinct().groupBy(
        "term", "kind").agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") >= support)
    rows = together.join(values, ["term", "kind"]).join(of_kind, "kind").withColumn("term_key", F.xxhash64("term")).join(corpus, "term_key")
    n = F.lit(float(n_lines))
    pmi = F.log(n * F.col("n_tk") / (F.col("n_t").cast("double") * F.col("n_k")))
    ic = F.log(n / F.col("n_k"))
    return rows.select("term", "kind", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)).alias("disclosure"))


def term_spans(lines: DataFrame, revealing: DataFrame) -> DataFrame:
    """(key, terms): per text the spans of revealing terms in lines with an entity of their kind."""
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    telling = lines.withColumn("kind", F.explode(kinds)).withColumn("term", F.explode(_terms(F.col("line")))).select(
        "key", "line_no", "kind", "term")
    hits = telling.join(revealing, ["term", "kind"]).groupBy("key", "line_no", "term").agg(
        F.max(F.struct("disclosure", "kind")).alias("top"))
    pieces = F.arrays_zip(F.split("line", TERM, -1).alias("gap"), F.regexp_extract_all("line", F.lit(TERM), F.lit(0)).alias("word"))
    words = lines.join(hits.select("key", "line_no").distinct(), ["key", "line_no"], "left_semi").select(
        "key", "line_no", "line_start", "spans", F.posexplode(pieces).alias("at", "piece"))
    order = Window.partitionBy("key", "line_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("piece.gap") + F.coalesce(F.length("piece.word"), F.lit(0))
    begin = (F.coalesce(F.sum(size).over(order), F.lit(0)) + F.length("piece.gap")).cast("int")
    placed = words.withColumn("begin", begin).filter("piece.word is not null").withColumn("stop", F.col("begin") + F.length("piece.word"))
    free = ~F.exists("spans", lambda s: (s["start"] < F.col("stop")) & (s["end"] > F.col("begin")))
    found = placed.filter(free).withColumn("term", F.lower("piece.word")).join(hits, ["key", "line_no", "term"])
    start = (F.col("line_start") + F.col("begin")).cast("int")
    return found.select("key", F.struct(
        start.alias("start"), F.lit(len(KINDS)).alias("rank"), (start + F.length("piece.word")).alias("end"), F.lit("term").alias("kind"),
        F.col("top.kind").alias("value"), F.col("top.disclosure").alias("disclosure")).alias("s")).groupBy("key").agg(
        F.array_sort(F.collect_list("s")).alias("terms"))


def sanitised(text: Column, spans: Column, remove: float) -> Column:
    """The text with entities replaced by their kind's name, and terms generalised or removed."""
    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] != "term", F.concat(F.lit("<"), s["kind"], F.lit(">"))).when(
            s["disclosure"] >= remove, F.lit("")).otherwise(F.concat(F.lit("<"), s["value"], F.lit(" context>")))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put)).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
             generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row: ``doc_id``; ``base`` and ``spans``, arrays of base spans and of all spans
    (start, rank, end, kind, value, disclosure) by start and kind; ``sanitized``, the text without
    them.  ``disclosure`` is null for base spans, whose ``value`` is the entity; a term's is the kind
    it gives away."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    key = F.when(F.size("spans") > 0, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    found = own.withColumn("key", key)
    hits = materialize(found.filter("key is not null").select("key", "text", "spans"))
    lines = materialize(entity_lines(hits))
    revealing = disclosures(lines, term_lines(docs, text_col), count_lines(docs, text_col), support).filter(F.col("disclosure") >= generalise)
    terms = term_spans(lines, revealing)
    wide = "array<struct<start: int, rank: int, end: int, kind: string, value: string, disclosure: double>>"
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
                                                   s["kind"].alias("kind"), s["value"].alias("value"), F.lit(None).cast("double").alias("disclosure")))
    every = F.array_sort(F.concat(base.cast(wide), F.coalesce(F.col("terms").cast(wide), F.array().cast(wide))))
    joined = found.join(terms, "key", "left").select("doc_id", "text", F.col("spans").alias("base"), every.alias("spans"))
    return joined.select("doc_id", "base", "spans", sanitised(F.col("text"), F.col("spans"), remove).alias("sanitized"))
