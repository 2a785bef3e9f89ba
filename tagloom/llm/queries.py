"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, decontam, langid, lattice, licenses, mixing, paradedup, pii, pivots, quotes
from .common import table
from .sql import ORACLES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits", "end")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.find(table(spark, sf_dir, "documents"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.find(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.learn(docs.where("not held_out"))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find(table(spark, sf_dir, "documents")))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.copies(table(spark, sf_dir, "documents")))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
