"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import bpe, chat, html_text, importance, line_dedup, media, merkle, mixing, near_dup, near_vectors, pii, topk, toxicity
from ledgerflow.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path and pattern of a public vocabulary; any other rank file and pattern will do."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_counts(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), *vocabulary())


#: The text of both turns of the conversation that op9 adds.
SAID = "\\### Assistant: </turn> ok"


def op9_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.unionByName(spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string")))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_near_duplicates": op2_near_duplicates,
        "op2_near_links": op2_near_links,
        "op3_html_text": op3_html_text,
        "op4_pii": op4_pii,
        "op5_exact_topk": op5_exact_topk,
        "op6_line_dedup": op6_line_dedup,
        "op7_mix_sources": op7_mix_sources,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_chat_trees": op9_chat_trees,
        "op10_telephony_audio": op10_telephony_audio,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_near_vectors": op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    extra = f"SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'"
    return {
        "op2_near_duplicates": near_dup.near_duplicates_sql(),
        "op2_near_links": near_dup.link_counts_sql(),
        "op5_exact_topk": topk.top_k_sql(),
        "op7_mix_sources": mixing.mix_sql(),
        "op9_chat_trees": chat.digest_sql(extra),
        "op11_merkle_manifest": merkle.digest_sql(),
        "op12_importance_resampling": importance.resample_sql(),
        "op13_near_vectors": near_vectors.near_vectors_sql(),
    }
