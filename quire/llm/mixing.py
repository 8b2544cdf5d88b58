"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic.  Raking finds one factor per source, per
language and per topic, so that the cells' tokens times their three factors have the target share
of every source, every language and every topic at once.  A cell's product of factors is the
relative weight of its tokens; scaled to the token budget, and no more than 1, it is the
probability with which each of its documents is sampled.

Sources may be many: they stay distributed, one row each with its cells, and a round is one
aggregation.  Languages and topics are few by nature (``MOST_CATEGORIES`` is checked): their
factors and the table of language by topic totals are what the driver holds.  Documents are joined
to their cells' weights, a join that adaptive execution broadcasts or splits as their sizes say.

Defined cases: null source, language or topic is a category of its own; null text counts as empty
and weighs no tokens, so it is sampled as its cell is; repeated rows share their id's fate; an
empty table gives no rows; a table without tokens, or a cell without any, is sampled with
probability 0; categories of a target that do not occur are left out of the shares; other columns
are ignored by ``mix_weights`` and kept by ``sample_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, unit_hash
from quire.llm.rules import SPACES

#: Shares of sources, languages and topics follow the tokens to this power where no target is given.
TEMPER = 0.7
#: Part of all tokens that the sample is to hold.
BUDGET = 0.5
ROUNDS, TOLERANCE = 100, 1e-9
MOST_CATEGORIES = 10_000
_NULL = "\u0000null"


def tokens(text: Column) -> Column:
    """Words of a text, the native stand-in for tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")).cast("long")


def form_topic(text: Column) -> Column:
    """A coarse topic from a text's form, for tables without a topic column."""
    t = F.coalesce(text, F.lit(""))
    marks = F.char_length(t) - F.char_length(F.translate(t, "|#$%&*<>", ""))
    digits = F.char_length(t) - F.char_length(F.translate(t, "0123456789", ""))
    return (F.when(marks * 20 > F.char_length(t), "table").when(digits * 50 > F.char_length(t), "figures")
            .when(F.char_length(t) < 1000, "note").when(F.char_length(t) < 5000, "article").otherwise("book"))


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(_NULL))


def _shares(totals: dict[str, float], target: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the categories that occur; tempered shares where none is given."""
    want = {k: v ** TEMPER for k, v in totals.items() if v > 0} if target is None else \
        {k: float(target[k]) for k, v in totals.items() if v > 0 and target.get(k, 0) > 0}
    every = sum(want.values()) or 1.0
    return {k: v / every for k, v in want.items()}


def _factor(key: Column, factors: dict[str, float]) -> Column:
    """The factor of a category; 0 for those that no target names."""
    if not factors:
        return F.lit(0.0)
    table = F.create_map(*[x for k, v in sorted(factors.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def _totals(cells: DataFrame, name: str) -> dict[str, float]:
    rows = cells.groupBy(name).agg(F.sum("n").alias("n")).limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{name} has more than {MOST_CATEGORIES} categories; use it as the source")
    return {r[name]: float(r["n"]) for r in rows}


def rake(cells: DataFrame, source_target: dict[str, float] | None = None, lang_target: dict[str, float] | None = None,
         topic_target: dict[str, float] | None = None) -> DataFrame:
    """(source, lang, topic, n) -> the same with ``weight``: the target share of all tokens that a
    token of the cell stands for.  The weighted tokens of all cells sum to 1."""
    langs, topics = _totals(cells, "lang"), _totals(cells, "topic")
    want_l, want_t = _shares(langs, lang_target), _shares(topics, topic_target)
    by_source = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "n")).alias("cells"), F.sum("n").alias("n"))
    if source_target is None:
        by_source = by_source.withColumn("want", F.pow("n", F.lit(TEMPER)))
    else:
        by_source = by_source.withColumn("want", F.when(F.col("n") > 0, _factor(F.col("source"), source_target)).otherwise(0.0))
    every = by_source.agg(F.sum("want").alias("s")).first()["s"] or 1.0
    by_source = materialize(by_source.withColumn("want", F.col("want") / F.lit(float(every))).drop("n"))

    def source_factor(fl: dict, ft: dict) -> Column:
        part = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * _factor(c["lang"], fl) * _factor(c["topic"], ft))
        return F.when(part > 0, F.col("want") / part).otherwise(0.0)

    fl, ft = dict.fromkeys(want_l, 1.0), dict.fromkeys(want_t, 1.0)
    for _ in range(ROUNDS):
        table = by_source.withColumn("f", source_factor(fl, ft)).select("f", F.explode("cells").alias("c")).groupBy(
            F.col("c.lang").alias("lang"), F.col("c.topic").alias("topic")).agg(F.sum(F.col("f") * F.col("c.n")).alias("m")).collect()
        before = {**fl}, {**ft}
        for own, other, name, rest, want in ((fl, ft, "lang", "topic", want_l), (ft, fl, "topic", "lang", want_t)):
            sums = dict.fromkeys(own, 0.0)
            for r in table:
                if r[name] in own:
                    sums[r[name]] += r["m"] * other.get(r[rest], 0.0)
            for k in own:
                own[k] = want[k] / sums[k] if sums[k] > 0 else 0.0
        change = max([0.0, *(abs(v - b[k]) / max(abs(b[k]), 1e-300) for f, b in zip((fl, ft), before, strict=True) for k, v in f.items())])
        if change < TOLERANCE:
            break
    weight = F.col("f") * _factor(F.col("c.lang"), fl) * _factor(F.col("c.topic"), ft)
    return by_source.withColumn("f", source_factor(fl, ft)).select("source", "f", F.explode("cells").alias("c")).select(
        "source", F.col("c.lang").alias("lang"), F.col("c.topic").alias("topic"), F.col("c.n").alias("n"), weight.alias("weight"))


def calibrate(weighted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability``: min(1, scale x weight), the scale such that the expected sample holds
    ``budget`` of all tokens that any target wants (cells at probability 1 pass on what they lack)."""
    total = weighted.agg(F.sum(F.when(F.col("weight") > 0, F.col("n"))).alias("n")).first()["n"] or 0
    scale, capped = budget * total, -1
    while total:
        full = F.lit(scale) * F.col("weight") >= 1
        s = weighted.agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(full, 1).otherwise(0)).alias("cells"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("n") * F.col("weight"))).alias("w")).first()
        if s["cells"] == capped or not s["w"]:
            break
        capped, scale = s["cells"], max(scale, (budget * total - s["n"]) / s["w"])
    return weighted.withColumn("probability", F.least(F.lit(1.0), F.lit(float(scale)) * F.col("weight")))


def _celled(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column, size: Column,
            extra: list[str] | None = None) -> DataFrame:
    carried = [F.struct(*[docs[c] for c in extra]).alias("row")] if extra else []
    return docs.select(docs[id_col].alias("doc_id"), _key(docs[source_col]).alias("source"), _key(docs[lang_col]).alias("lang"),
                       _key(topic).alias("topic"), size.alias("n_tokens"), *carried)


def mix_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                topic: Column | None = None, size: Column | None = None, source_target: dict[str, float] | None = None,
                lang_target: dict[str, float] | None = None, topic_target: dict[str, float] | None = None, budget: float = BUDGET,
                seed: str = "mix", extra: list[str] | None = None) -> DataFrame:
    """One row per row: doc_id, source, lang, topic, n_tokens, weight (relative to its tokens' own
    share: above 1 is sampled more than the average token), probability, sampled.  ``topic`` and
    ``size`` are columns of ``docs`` (by default its form and its words)."""
    topic = form_topic(docs[text_col].cast("string")) if topic is None else topic
    size = tokens(docs[text_col].cast("string")) if size is None else size
    rows = _celled(docs, id_col, text_col, source_col, lang_col, topic, size, extra)
    cells = materialize(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")))
    every = cells.agg(F.sum("n").alias("n")).first()["n"] or 0
    table = materialize(calibrate(rake(cells, source_target, lang_target, topic_target), budget).select(
        "source", "lang", "topic", (F.col("weight") * F.lit(float(every))).alias("weight"), "probability"))
    shown = [F.when(F.col(c) != _NULL, F.col(c)).alias(c) for c in ("source", "lang", "topic")]
    return rows.join(table, ["source", "lang", "topic"]).select(
        "doc_id", *shown, "n_tokens", "weight", "probability", (unit_hash(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"),
        *(["row"] if extra else []))


def sample_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The sampled rows, with all their columns."""
    return mix_weights(docs, extra=docs.columns, **parameters).filter("sampled").select("row.*")
