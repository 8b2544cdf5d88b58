"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing
and packing, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of ``docs``, the last
one the pieces of sequences.  Null texts count as empty, which the first stage rejects; an empty
table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, neardup, packing, queries, rules, secrets
from quire.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that break a rule go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near copies the document of least id stays."""
    return neardup.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets, also those in encoded layers, are masked in the texts."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents sampled by the probabilities of their raked cells."""
    return mixing.sample_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the rest as sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Sketches, decoding and tokenising have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
