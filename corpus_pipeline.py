"""A corpus pipeline of five of the operators: quality, near copies, benchmark leaks, personal data, encoding.

Each stage takes all that its predecessor kept and returns the columns of its input (the last one adds the ids). Rows of any kind
pass: a null or empty text is scored as such and stays if the classifier keeps it, has no near copies, leaks nothing, holds no
personal data and gets no ids (null for null); very long texts are handled whole; repeated rows are near copies of each other, of
which one stays; rows without an id or with a shared one are judged each by its own text; further columns stay, whatever their
names, but for those that the last stage adds; an empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, pii, quality, sentencepiece_codec
from tidemark.llm.common import stash, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its ids, and whether they decode to it."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's output written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stash(docs), sf_dir)
    return docs


#: The stages hold trained models and random paths, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None
