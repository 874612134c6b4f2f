"""A training corpus made of documents: five stages, each calling one operator, each on all that its predecessor kept.

1. language_id rejects documents in which no language can be told: texts of letters that look like none of the
   languages. Models are trained on a bounded sample of lang; a document's own lang is no evidence, its source is.
2. near_dedup keeps one document of each group of near-duplicates: the one of the smallest doc_id.
3. decontamination rejects documents that hold a window of a benchmark item.
4. secret_scan masks secrets; it rejects nothing.
5. packing makes sequences of the tokens.

All but the last return the columns of documents, n_chars brought up to date where a text changed. Rows repeated under
one doc_id are one document and share its fate; rows without a doc_id stay. Null and empty texts stay, and are packed as
an end token; texts of any length go through every stage whole. Of an empty table nothing is left, in the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm import decontaminate, language, neardup, packing, secrets
from veritrail.llm.common import staged, table, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    asked = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit("").alias("domain"))
    told = language.identify(asked, docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    return without(docs, told.where("not accepted").select(F.col("id").alias("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, neardup.near_duplicates(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]
#: Trained models and token ids can't be had in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
