"""A training corpus from raw documents: grade, drop copies, drop near copies, mix sources, tokenise.

Every stage works on all rows its predecessor kept and returns the columns of documents, the last one
digests. Null texts count as empty, null ids are ids like others and come last where the least or largest
wins, rows that repeat an id and a text stay or go together, extra columns are carried along whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodeframe.llm import exact_dedup, mixing, partenum, quality, sentencepieces
from episodeframe.llm.common import stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least 0.5; a probability of 0.5 stays."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id. Null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: the one with the smallest id, of
    several texts of one id the one with the least hash. Documents without words all stay."""
    return partenum.drop_similar(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them. Documents without words carry no weight and are left out; a null source is a source."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document of the mix, a row for each time it is taken."""
    return sentencepieces.digests(docs)


STAGES = [("classify", classify), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("mix", mixture), ("tokenise", tokenise)]

#: The classifier, the fingerprint join and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before it kept, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
