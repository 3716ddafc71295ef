"""Registered queries: each applies one operator to its whole table, and the SQL that must give the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planloom.llm import (context_tree, decontaminate, language, merkle, mixing, phrases, quality, repair, repeats, run_index, simhash,
                          token_store, warc)
from planloom.llm.sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary file that the queries use; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_index.drop_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed_copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.drop_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.edit_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_simhash, op3_context_tree, op4_decontaminate, op5_language, op6_quality,
                                   op7_run_index, op8_mixing, op9_repeats, op10_phrases, op11_warc, op12_repair, op13_merkle)}

__all__ = ["QUERIES", "SQL"]
