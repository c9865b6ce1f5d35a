"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, secret scans, packing.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import line_dedup, minhash_dedup, quality_cnn, secret_scan
from segmenta.llm.common import materialize, read_table
from segmenta.llm.queries import packed


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_cnn.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the texts; ``n_chars`` follows."""
    return line_dedup.dedup_lines(docs).select(
        *(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, ``n_chars`` follows; no document goes."""
    clean = secret_scan.redact_secrets(docs)
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the sequences."""
    return packed(docs)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", scan_secrets),
    ("packing", pack_sequences),
]

#: No SQL: classifier, rolling hashes, signatures and tokens are beyond it.  Tests hold
#: the operators against brute force, and the columns and ids that the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
