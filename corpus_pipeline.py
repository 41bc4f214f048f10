"""Documents to pieces in five stages: quality, near copies, benchmark passages, personal data, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, pieces, pii, quality, simhash
from plumbline.runtime import Scratch, workspace


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules; null and blank texts fail, equal rows are judged alike, an empty table stays empty."""
    return quality.keep_good(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest doc_id, null last; of equal rows one stays; texts without words are one group."""
    return simhash.deduplicate(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null texts and items hold nothing, each text of a doc_id has its own verdict."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; null texts stay null, ``n_chars`` follows the text, no row goes."""
    return pii.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and how it was segmented; a null text counts as empty, equal rows give equal rows."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_first),
    ("benchmark decontamination", keep_clean),
    ("PII", mask_personal),
    ("SentencePiece encoding", to_pieces),
]

#: Fingerprints, patterns and pieces are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again; what a stage leaves in the shared folder goes with it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with workspace(spark, f"pipeline-{k}"):
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
