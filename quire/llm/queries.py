"""The registered queries of the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import fingerprint, infill, labels, langid, lexical, mixing, neardup, packing, pii, quality, rules, secrets, toxicity, url_filter
from quire.llm.common import read_table

BPE_RANKS = "byte_bpe_50k.tiktoken"


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on every document, learnt outside the fold of remainder 1 of 3."""
    held_out = labels.fold(F.col("doc_id"), 3) == 1
    scores = quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return _judged(scores, held_out)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 on every document: base findings, and those in unwrapped layers."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["chain"] == "")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", F.when(s["chain"] == "", s["kind"]).otherwise(F.concat(s["kind"], F.lit("@"), s["chain"])), s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "complete")


#: The rules of operator 3.
URL_RULES = [url_filter.Rule(*r) for r in (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on every page: links from the pages' own heads and canonical forms."""
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.declared_links(pages), URL_RULES)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 on every document, its edited text and its next document."""
    return fingerprint.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 on every document, learnt outside the fold of remainder 0 of 5."""
    held_out = labels.fold(F.col("doc_id"), 5) == 0
    scores = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return _judged(scores, held_out)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on every document: its class of near copies."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 on every document: counts, base verdict and the rule table's verdict."""
    return rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_upper_chars", "n_stop_words", "n_distinct_words",
        F.concat_ws(",", "broken").alias("broken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on every document: source, language and topic shares tempered, half the tokens."""
    return mixing.mix_weights(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on every document: entities, and terms that the corpus shows to reveal them."""
    found = pii.sanitise(read_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count("term").alias("n_term"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on every document: sequences of at most 2048 ids."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 on every document, learnt outside the fold of remainder 2 of 4."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = labels.fold(F.col("doc_id"), 4) == 2
    return langid.identify_languages(docs, ~held_out).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: of all documents the 50 best for every benchmark item."""
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 on every document: the output's digest and that of the text rebuilt from it."""
    return infill.infill_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_secret_scan, op3_url_filter, op4_fingerprints, op5_toxicity, op6_near_duplicates, op7_quality_rules, op8_source_mixing, op9_pii, op10_best_fit_packing,
    op11_language_id, op12_ranked_search, op13_fill_in_middle)}
