"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import divergence, fingerprints, jaccard_join, language_id, licenses, oracles, packing, pieces, pii, quality_rules, suffix_dedup, token_counts, tool_calls, whitening
from roadloom.llm.common import documents

#: For the queries on invented data; a real corpus takes a key of its own from a secret store.
PSEUDONYM_KEY = "roadloom example key"
#: ``op11`` marks texts with more tokens than this.
TOKEN_LIMIT = 512


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir, "doc_id", "text"), PSEUDONYM_KEY, count="n_pseudonyms")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return tool_calls.link_tool_calls(*tool_calls.turns_as_calls(turns), tool_calls.turn_schemas(spark))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir, "doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir, "doc_id", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(documents(spark, sf_dir, "doc_id", "text"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer("byte_bpe_50k.json"), TOKEN_LIMIT)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_pseudonyms, op2_tool_calls, op3_best_fit_packing, op4_suffix_dedup, op5_license_scan, op6_sentencepiece, op7_quality_rules, op8_fingerprints, op9_language_id, op10_jaccard_join, op11_token_counts, op12_source_divergence, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_tool_calls": tool_calls.TURNS_SQL,
        "op5_license_scan": licenses.scan_sql(),
        "op7_quality_rules": oracles.QUALITY_SQL,
        "op10_jaccard_join": oracles.LINKS_SQL,
        "op12_source_divergence": divergence.AUDIT_SQL,
    }
