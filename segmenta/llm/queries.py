"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over the whole of
their tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import (
    byte_bpe_codec,
    exact_dedup,
    fingerprints,
    line_dedup,
    minhash_dedup,
    packing,
    pii,
    quality_cnn,
    secret_scan,
    sentencepiece_codec,
    sharding,
    vector_codes,
    whitening,
)
from segmenta.llm.common import read_table


def _model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op1_exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_codec.codec_digests(docs, _model("piece_bpe_32k.model"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack(docs, *map(_model, names), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_codec.codec_digests(read_table(spark, sf_dir, "documents"), _model("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_sentencepiece, op3_packing, op4_quality_cnn, op5_pii,
    op6_minhash_dedup, op7_secret_scan, op8_line_dedup, op9_sharding, op10_fingerprints,
    op11_vector_codes, op12_whitening, op13_byte_bpe,
)}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op11_vector_codes": vector_codes.oracle_sql()}
