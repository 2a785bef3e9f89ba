"""The corpus pipeline: language ID, near-dedup, decontamination, PII, mixing.

``run`` writes each stage's result to the shared checkpoint folder and reads it again as the next stage's
documents. All stages but the last return the columns of documents. Null texts are rejected by the first
stage, so later ones see none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bagminhash, decontam, langid, mixing, pii
from tagloom.llm.common import settle, table

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no learned language."""
    return langid.keep(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near-duplicates."""
    return bagminhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item within its error budget."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with the number of copies that the mix takes."""
    return mixing.digest(mixing.copies(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
