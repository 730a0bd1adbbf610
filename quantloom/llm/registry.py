"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, chat, decontam, langid, licenses, merkle, mixing, neardup, prefixes, sketch, tokenids, topk, wordpiece
from quantloom.llm.common import read


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(read(spark, sf_dir, "conversations"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(read(spark, sf_dir, "documents"))


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85, width=5)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_neighbours(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_language_id, op2_chat_perspectives, op3_license_scan, op4_token_counts, op5_source_mixing, op6_iblt_fingerprints, op7_token_id_files, op8_minhash_near_dedup, op9_exact_topk, op10_byte_bpe, op11_prefix_trie, op12_decontamination, op13_merkle_manifest)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_perspectives": chat.ORACLE, "op3_license_scan": licenses.ORACLE, "op5_source_mixing": mixing.ORACLE, "op9_exact_topk": topk.ORACLE, "op11_prefix_trie": prefixes.ORACLE, "op12_decontamination": decontam.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
