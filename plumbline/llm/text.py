"""Words and shingles, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker: rows may hold very long texts, so their number bounds nothing.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH`` bytes, or one row, at most from here on; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key)
    if not given.isdigit() or not 0 < int(given) <= BATCH:
        spark.conf.set(key, str(BATCH))


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` and ``bytes.lower`` know ASCII only, as wanted."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of a string column, one row at least, so that what a task holds does not follow the rows of a batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(c: Column, lower: bool = True) -> Column:
    """Words of a text column as an array; null and blank texts give an empty array."""
    kept = F.coalesce(c, F.lit(""))
    return F.filter(F.split(lower_ascii(kept) if lower else kept, GAP), lambda w: w != "")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) of the components that the links a-b make."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
