"""Corpus pipeline: five stages from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads.  The
first four keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import language, packing, secret_scan, simhash, toxicity
from seedloom.llm.common import Saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected grade says clean; the model learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    graded = docs.select(*COLUMNS, toxicity.toxicity("text", model).alias("_t"))
    return graded.where(~F.col("_t.toxic")).select(*COLUMNS)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or too unlikely in all of them, are rejected.

    A null ``lang`` is filled with the prediction; a given one stays.
    """
    model = language.with_floor(docs, language.train(docs))
    found = docs.select(*COLUMNS, language.language("text", model).alias("_l"))
    kept = found.where((F.col("_l.lang_pred") != "und") & (F.col("_l.nats") >= model.floor))
    return kept.withColumn("lang", F.coalesce("lang", F.col("_l.lang_pred"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Of rows that repeat this id one stays, the smallest by its columns; rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    lost = Saved(spark)(simhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("_keep"), F.count("*").alias("_n")).where("not _keep or _n > 1"))
    rest = docs.join(lost.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    again = lost.where("_keep").select("doc_id")
    if again.isEmpty():
        return rest
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_first")).select("doc_id", "_first.*")
    return rest.unionByName(one)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    found = secret_scan.find_secrets(docs.select(*COLUMNS), secret_scan.train(docs, "doc_id", "text"))
    hidden = found.withColumn("_n", F.size("secrets")).withColumn("text", secret_scan.masked(found))
    length = F.when(F.col("_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", length).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.pack(packing.with_pack_columns(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_windows),
]

#: SQL cannot fit or apply the models; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read by the next."""
    saved = Saved(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
