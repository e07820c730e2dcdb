"""The subpackage's queries, `opN_<name>` and `pipeline`, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillgraph.llm import chat, decontamination, language, linededup, merkle, oracles, packing, passages, pii, sharding, simhash, spotsigs, toxicity, trie
from quillgraph.llm.common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_duplicates(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(read_table(spark, sf_dir, "documents"))


def op7_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=40)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_documents_pii(read_table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_read_back(read_table(spark, sf_dir, "conversations"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def llm_spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fingerprint classes at least 0.8 alike, by size partitions and pruned Jaccard."""
    return spotsigs.near_duplicates(read_table(spark, sf_dir, "documents"))


def llm_weighted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendezvous hashing over eight shards, the last of which are of double weight."""
    return sharding.weighted_shards(read_table(spark, sf_dir, "documents"), [1.0] * 6 + [2.0] * 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_spotsigs_fingerprints": op7_spotsigs_fingerprints,
    "op8_rendezvous_sharding": op8_rendezvous_sharding,
    "op9_pii": op9_pii,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
    "llm_spotsigs_near_duplicates": llm_spotsigs_near_duplicates,
    "llm_weighted_shards": llm_weighted_shards,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
