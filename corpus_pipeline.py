"""A corpus pipeline: stages that each filter, rewrite or pack what the stage before kept.

Each stage takes (spark, docs, sf_dir), ``docs`` being what its predecessor kept, and applies one operator to all
of it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import language, line_dedup, packing, simhash, toxicity
from tallyframe.llm.common import table
from tallyframe.llm.queries import word_bpe
from tallyframe.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not clear go. Dictionaries come from the documents that state a language."""
    return language.drop_unclear(docs, language.trained(docs))


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is trained on the labelled ones among those that are left."""
    return toxicity.drop_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and with them documents of which nothing is left."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by windows of five words and a similarity of 0.8, one document stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with the mixture of sources that the kept documents have."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

# SQL cannot express the trained models and fingerprints; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
