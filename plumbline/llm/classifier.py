"""Document quality by regularised quadratic discriminant analysis.

Every text becomes ``FEATURES`` statistics, brought near to normal by logarithms
and logits.  The labelled training documents are found by a join on doc_id; each
class's count, sums and products of statistics are added up in the tasks, one row
each, so all labelled documents count and none is collected.  The class
covariances are shrunk twice: toward the pooled one (``POOL``) and that toward its
own diagonal (``RIDGE``).  Their Cholesky factors are made once, and every text is
scored by the difference of the two log densities, the Mahalanobis distances taken
through the factors, plus the log of the classes' sizes; the score is the logistic
of it.  Label, language, source and id are never statistics.

Defined cases: a null text counts as empty and gets a score like any other; a null
doc_id has the checksum of the empty string, so it is held out; equal rows are
scored alike; labels that are null, or neither 0 nor 1, teach nothing, a document
with several labels teaches each of them once; with fewer than ``MIN_CLASS``
documents of a class all scores are the share of label 1 (0.5 if there is no label);
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quality import repeat_words
from plumbline.llm.text import bound_batches, sliced
from plumbline.runtime import Scratch

#: Shrinkage toward the pooled covariance and its diagonal; the least documents of a class; the least score of label 1.
POOL, RIDGE, MIN_CLASS, CUT = 0.3, 0.1, 5, 0.3
FEATURES = ["words", "word_length", "symbols", "capitals", "digits", "stops", "bars", "exclamations", "repeats", "lines", "variety", "line_words", "packed"]
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS, _DIGITS, _STOPS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"#$%&*<>=_~^\\{}[]@"


def _share(part: float, whole: float) -> float:
    """The logit of a share, smoothed by half a case."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = (text or "").encode()
    found = raw.split()
    n = len(found)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    chars = len(raw) - count(_SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    sample = len(zlib.compress(raw, 1)) if raw else 0
    return [
        math.log(1 + n),
        math.log((chars + 1) / (n + 1)),
        _share(count(_SYMBOLS), chars),
        _share(count(_CAPITALS), chars),
        _share(count(_DIGITS), chars),
        _share(count(_STOPS), chars),
        _share(raw.count(b"|"), chars),
        _share(raw.count(b"!"), chars),
        _share(repeat_words(found), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log((len(set(found)) + 1) / (n + 1)),
        math.log((n + 1) / (len(lines) + 1)),
        math.log((sample + 16) / (len(raw) + 16)),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, x)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), x], ["doc_id", "held_out", "x"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class: documents, sums and products of ``x``, added up in the tasks and then by Spark."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (d + 1) ** 2))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("y"))
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                total[k] += (x[y == k].T @ x[y == k]).ravel()
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array((at // total.shape[1]).astype(np.int32)), pa.array((at % total.shape[1]).astype(np.int32)), pa.array(total.ravel())], ["y", "k", "s"])

    sums = rows.select("x", "y").mapInArrow(run, "y int, k int, s double").groupBy("y", "k").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for k in (0, 1):
        s = np.zeros((d + 1) ** 2)
        part = sums[sums["y"] == k]
        s[part["k"].to_numpy()] = part["s"].to_numpy()
        s = s.reshape(d + 1, d + 1)
        out[k] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return out


class Model:
    """Means, inverted Cholesky factors and log determinants of the two classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = np.array([sums[k][0] for k in (0, 1)])
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.fitted = bool(n.min() >= MIN_CLASS)
        if not self.fitted:
            return
        self.means = [sums[k][1] / n[k] for k in (0, 1)]
        own = [sums[k][2] / n[k] - np.outer(self.means[k], self.means[k]) for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        floor = 1e-3 + np.diag(pooled)
        target = (1 - RIDGE) * pooled + RIDGE * np.diag(floor)
        self.factors, self.logs = [], []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - POOL) * own[k] + POOL * target)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(float(np.log(np.diag(factor)).sum()))
        self.prior = math.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - self.logs[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -700, 700)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scratch = Scratch(docs.sparkSession, "classifier")
    rows = scratch.save(measured(docs), "statistics")
    taught = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("#id"), F.col(label).cast("int").alias("y")).distinct()
    model = Model(moments(rows.where("not held_out").join(taught, F.col("doc_id") == F.col("#id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
