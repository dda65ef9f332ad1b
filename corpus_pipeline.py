"""From raw documents to packed sequences: five stages, each one of the training-data operators.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns the
packed pieces. ``run`` writes each stage's result as parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, ngram_join, packing, quality_fm, suffix_dedup
from sparkloom.llm.common import discard, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 250 bytes or more that occur more than once."""
    return suffix_dedup.cut_texts(docs, length=250)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("suffix_dedup", passages), ("packing", pack)]
#: SQL cannot express a trained classifier or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if i:
                discard(before)
    return docs
