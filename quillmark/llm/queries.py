"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, divergence, embedding_dedup, language, line_dedup, minhash, mixing, negatives, pieces, quality, secret_scan, sharding, substring_dedup
from quillmark.llm.common import table

SHARD_BYTES = 1 << 20


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, third = table(spark, sf_dir, "documents"), quality.fold(F.col("doc_id"), 3)
    out = language.label_languages(docs, learn=third != 1)
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, quarter = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.fold(F.col("doc_id"), 4)
    out = quality.score_quality(docs, labels, learn=quarter != 2)
    return out.select("doc_id", F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return shards.select("doc_id", "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_docs", "oversized")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest(pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine_negatives(moved, i % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_sharding": sharding.oracle(SHARD_BYTES),
    "op12_hard_negatives": negatives.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
