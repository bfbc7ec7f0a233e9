"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import decontamination, fingerprints, importance, language_id, line_dedup, piece_codec, simhash_dedup, suffix_dedup, token_counts, token_files
from pixelloom.llm.base import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"), tau=line_dedup.TAU)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.cross_checked(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES, limit=4096)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=8, least_items=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", simhash_dedup.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), BYTES, end_id=2)


def op10_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_line_dedup, op2_language_id, op3_token_counts, op4_decontamination, op5_suffix_dedup, op6_winnowing, op7_simhash, op8_importance, op9_token_files, op10_piece_round_trip)
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontamination.ORACLE_SQL}
