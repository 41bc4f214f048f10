"""Joins of documents with what was found about some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the small side, under 50 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def near(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written frame, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _by_text(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    found = near(keys.toDF("#id", "#h"))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("#id")) & (F.xxhash64(docs["text"]) == F.col("#h")), how)


def without_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose doc_id and hash of the text are not a row of a written frame; null equals null."""
    return _by_text(docs, keys, "left_anti")


def among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose doc_id and hash of the text are a row of a written frame; null equals null."""
    return _by_text(docs, keys, "left_semi")
