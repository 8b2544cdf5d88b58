"""Quality rules: a threshold table compiled into one projection, no user functions.

``measures`` names what is counted in a text as Spark columns; ``RULES`` is a table of
(measure, lowest, highest) bounds; ``compile_rules`` turns the table into a verdict and a
list of the rules a text breaks.  Everything is one narrow projection over the scan: no
shuffle, no Python, and per-text work of n log n at most in the text's words.

Words are runs of characters other than space and U+0009 to U+000D.  Defined cases: null
text counts as empty; a text with no word fails the base; every row is judged alone, so
repeated rows get equal verdicts; an empty table gives no rows; other columns are ignored by
``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "was", "on", "by", "it", "be", "this",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
    "el", "y", "los", "del", "se", "las", "por", "con", "no", "su", "para", "al", "lo",
]

#: (measure, lowest, highest): null means no bound on that side.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("repeat_word_ratio", None, 0.20),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.10),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
    ("upper_char_ratio", None, 0.50),
    ("distinct_word_ratio", 0.05, None),
    ("stop_words_missing", None, 0),
]
#: Texts of at least so many words must have a stop word among them.
STOP_WORD_FROM = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by 64-bit hashes.  Where no hash occurs twice there is none; else the
    hashes are sorted with their places, so that equal windows are neighbours, and overlapping
    windows count their words once."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)),
                           lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))

    def places(s: Column) -> Column:
        n = F.size(s)
        return F.array_sort(F.transform(
            F.filter(F.transform(s, lambda x, i: F.struct(
                x["p"].alias("p"),
                (((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < n) & (F.get(s, i + 1)["h"] == x["h"]))).alias("twice"))),
                lambda x: F.coalesce(x["twice"], F.lit(False))),
            lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct(
            (x + width).alias("end"), (a["n"] + width - F.greatest(F.lit(0), a["end"] - x)).cast("long").alias("n")))["n"]

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(let(placed, places)))

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


def parts(text: Column) -> dict[str, Column]:
    """A text's words and its lines that have a word, which the measures share."""
    return {"_text": text, "_words": words_of(text),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")}


def measures() -> dict[str, Column]:
    """What the rules look at, from a text's parts; each is a number per text."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_window_words(words),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•‣·]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
        "n_upper_chars": (F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS + [x.capitalize() for x in STOP_WORDS]))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(words)).cast("long"),
    }


def ratios() -> dict[str, Column]:
    """The measured counts as the ratios that the table bounds; a ratio over nothing is null."""
    def over(a, b):
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "upper_char_ratio": over("n_upper_chars", "word_chars"),
        "distinct_word_ratio": over("n_distinct_words", "n_words"),
        "stop_words_missing": ((F.col("n_words") >= STOP_WORD_FROM) & (F.col("n_stop_words") == 0)).cast("double"),
    }


def compile_rules(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """The names of the rules a row breaks, in the table's order; null ratios break none."""
    have = ratios()
    broken = []
    for name, low, high in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (have[name] < low)
        if high is not None:
            bad = bad | (have[name] > high)
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: list[tuple[str, float | None, float | None]] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Per row: its id, all measures, ``broken`` (names of broken rules), ``base_failed`` and
    ``kept``.  ``extra`` names columns carried along under a struct ``row``."""
    rules = RULES if rules is None else rules
    carried = [F.struct(*[docs[c] for c in extra]).alias("row")] if extra else []
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keys = ["doc_id", *(["row"] if extra else [])]
    split = docs.select(docs[id_col].alias("doc_id"), *carried, *[c.alias(n) for n, c in parts(text).items()])
    counted = split.select(*keys, *[c.alias(n) for n, c in measures().items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("broken", compile_rules(rules)).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that break no rule, with all their columns."""
    judged = judge(docs, id_col, text_col, extra=docs.columns)
    # a random column keeps the optimizer from copying every measure into the filter's condition
    return judged.withColumn("_once", F.rand(0)).filter(F.col("kept") & (F.col("_once") >= 0)).select("row.*")
