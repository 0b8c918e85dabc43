"""The dealt operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, filter_audit, hard_negatives, language, neighbours, packing, pieces, preference, quality_rules, secret_scan, simhash, templates, toxicity
from .common import remainder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentation_digest(table(spark, sf_dir, "documents"), PIECES)


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secret_digest(docs, secret_scan.train(docs, "doc_id", "text"))


def op4_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = preference.train(docs, labels.where(remainder("doc_id", 3) != 1))
    scored = preference.classify(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs", "proportions")


def op8_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_pack_columns(table(spark, sf_dir, "documents")))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_compression_bands, op2_nbest_pieces, op3_markov_secrets, op4_preference_quality, op5_template_text,
        op6_nn_descent, op7_language_mixture, op8_conflict_packing, op9_simhash_trie, op10_ordinal_toxicity,
        op11_filter_audit, op12_positional_index, op13_residue_gemm,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The first ten have no plain SQL form; each is tested against a plain version of itself."""
    return {
        "op11_filter_audit": filter_audit.FILTER_AUDIT_SQL,
        "op12_positional_index": contamination.CONTAMINATION_SQL,
        "op13_residue_gemm": hard_negatives.HARD_NEGATIVES_SQL,
    }
