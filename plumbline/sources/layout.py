"""Layouts of a generation: postings by group and by document, sorted in ranges, with an index of their blocks.

Ranges of groups or documents are files of their own, sorted inside, so that a
filter on the key reads few of them and few row groups; a block is up to
``BLOCK`` records of one key in order, and its index says which documents,
targets or lines it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.aggregates import BLOCK, _block, block_stats, interval_stats


def by_group(postings: DataFrame, files: int = 200, size: int = BLOCK) -> dict[str, DataFrame]:
    """Tables group_posting, with each record's block, and block_index."""
    rows = postings.withColumn("block_no", _block(["symbol_ord"], ["doc_ord", "ps", "pe", "seq"], size))
    order = ["symbol_ord", "block_no", "doc_ord", "ps", "pe", "seq"]
    return {"group_posting": rows.repartitionByRange(files, "symbol_ord", "block_no").sortWithinPartitions(*order), "block_index": block_stats(postings, size)}


def by_document(occurrences: DataFrame, files: int = 200, size: int = BLOCK) -> dict[str, DataFrame]:
    """Tables doc_posting, with each record's block, and interval_index."""
    rows = occurrences.withColumn("block_no", _block(["doc_ord"], ["ps", "pe", "seq"], size))
    order = ["doc_ord", "block_no", "ps", "pe", "seq"]
    return {"doc_posting": rows.repartitionByRange(files, "doc_ord", "block_no").sortWithinPartitions(*order), "interval_index": interval_stats(occurrences, size)}


def state(docs: DataFrame) -> DataFrame:
    """doc_state (uri, prev_epoch, prev_md5): what the next generation asks of this one."""
    return docs.select("uri", F.col("epoch").alias("prev_epoch"), F.col("md5").alias("prev_md5"))


def records(postings: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The records of some blocks (key, block_no)."""
    return postings.join(blocks.select(key, "block_no").distinct(), [key, "block_no"], "left_semi")


def blocks_with_target(index: DataFrame, target: int) -> DataFrame:
    """(symbol_ord, block_no) of the blocks that hold a target; the others need not be read."""
    return index.where(F.array_contains(F.split("targets", ","), str(target))).select("symbol_ord", "block_no")
