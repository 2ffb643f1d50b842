"""The registered queries of this subpackage: each applies one operator, as it runs in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, html_extract, lexical, mixing, near_dedup, packing, quality, secrets, sharding, suffix_dedup, topk, whitening
from ._common import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op2_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, topk.queries_of(vectors))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_control_case(table(spark, sf_dir, "conversations"))))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "pieces")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scanned(table(spark, sf_dir, "documents")))


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_dense_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_vector_approximation_topk": op2_vector_approximation_topk,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_mixing": op5_mixing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_best_two_fit_packing": op8_best_two_fit_packing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_hilbert_sharding": op11_hilbert_sharding,
        "op12_dense_lexical_search": op12_dense_lexical_search,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_vector_approximation_topk": topk.ORACLE_SQL,
        "op3_chat_formatting": chat.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_hilbert_sharding": sharding.ORACLE_SQL,
        "op12_dense_lexical_search": lexical.ORACLE_SQL,
    }
