"""The corpus pipeline: five stages over ``documents``, each an operator of the training-data subpackage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
``documents``; the last one adds the token columns.  Texts may be null, empty or very long and rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, language, pieces, simhash, toxicity
from graphloom.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated toxicity score rejects go."""
    return toxicity.drop_toxic(docs, toxicity.trained(spark, sf_dir))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learnt, go."""
    return language.drop_unidentified(docs, language.trained(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as SentencePiece ids, and whether decoding them gives the text back."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

#: models and fingerprints are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
