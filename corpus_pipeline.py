"""A training corpus from raw documents: rules, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the
shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, pii, quality_rules, sentencepieces
from tidemark.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a row's verdict is its own, with or without a doc_id."""
    return quality_rules.filtered(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once if its row is repeated. Rows
    without a doc_id are compared too, by a name that follows from their text and comes behind all doc_ids below 2^62. Of
    rows with one doc_id and different texts, each text stays."""
    name = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    named = docs.withColumn("tm_name", name)
    groups = jaccard_join.joined(spark, named.select(F.col("tm_name").alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("tm_rows"))
    kept = named.join(first.withColumnRenamed("doc_id", "tm_name"), "tm_name")
    again = kept.where("tm_rows > 1").dropDuplicates(["tm_name", "text"])  # few names have two rows
    return kept.where("tm_rows = 1").union(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the names of its kinds."""
    return pii.masked(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies repeat its row."""
    return mixing.repeated(spark, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the columns of documents, and whether they agree with the other library and decode to the text."""
    return sentencepieces.encoded(spark, docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("sentencepiece", token_ids)]

#: Estimates, training and rounds have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(spark, function(spark, docs, sf_dir), name)
    return docs
