"""Queries of the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe_transducer, exact_dedup, impact_slices, language_ecoc, license_scan, ngram_join, packing, quality_fm, suffix_dedup, toxic_grammar, vector_tree, warc_zstd, word_runs
from sparkloom.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ecoc.identify(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packing_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of op3 with all three capacities binding: at most 2048 tokens, 12 pieces and half the attention cost
    of one whole sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_docs=12, max_cost=2048.0**2 / 2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.search(table(spark, sf_dir, "embeddings"))


def op7_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_impact_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_slices.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labels(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_warc, op2_language_id, op3_best_fit_packing, op4_suffix_dedup, op5_bpe_transducer, op6_vector_tree, op7_toxic_grammar, op8_quality_classifier, op9_ngram_join, op10_exact_dedup, op11_impact_slices, op12_word_runs, op13_license_scan)
    return {f.__name__: f for f in (*numbered, packing_limits)}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_impact_slices": impact_slices.SQL, "op12_word_runs": word_runs.SQL}


OP10_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
