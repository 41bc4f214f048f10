"""Whitening of embeddings over exactly centred rows.

Entries become whole numbers, x = floor(64 * entry) + 1000000.  The fit list
holds each different x once: equal vectors meet in a partial aggregate before
any shuffle, so a vector that a third of all rows share costs one row of each
task.  Sums are exact; the rows are centred by the whole part of the mean in
whole numbers and then by its fraction, so the centring rounds once.  MLlib's
``RowMatrix.computeGramianMatrix`` over the centred rows, divided by their
number, is the covariance; its eigenvectors are found on the driver (a matrix
of the vectors' length squared, whatever the number of rows) and go to
``mapInPandas``, which projects every row.  A second pass over the fit list
measures how far the projections' covariance is from the identity.

Defined cases: rows with a null vector, or null or non-finite entries, go;
equal rows and rows with a null id each stay; a vector shorter than the longest counts
the entries that it lacks as zero; entries beyond 2**52 in size count as that; a
component whose eigenvalue is below 1e-12 of the largest has no direction and is
left out, so a fit list of one vector, or an empty table, gives no rows; a deviation
beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import bound_batches
from plumbline.runtime import Scratch

#: Components that are returned; the grid and the shift of entries; the largest entry on the grid; the least eigenvalue as a share of the largest.
COMPONENTS, GRID, SHIFT, LARGEST, LEAST = 16, 64, 1_000_000, 1 << 52, 1e-12
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vector: Column) -> Column:
    """Vectors without null, NaN or infinite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def on_grid(vector: Column, length: int) -> Column:
    """The whole numbers x of a vector, filled up to ``length``."""
    bound = float(LARGEST)
    x = F.transform(vector, lambda c: F.floor(F.least(F.greatest(GRID * c.cast("double"), F.lit(-bound)), F.lit(bound))) + SHIFT)
    return F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), length - F.size(vector)))


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(v.item()) for v in values))


class Fit:
    """What the fit list says: n, exact sums, and the whitening of centred rows."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)
        e, v = np.linalg.eigh(covariance)
        e, v = e[::-1], v[:, ::-1]
        kept = e > LEAST * max(e[0], 0.0) if len(e) else np.zeros(0, bool)
        kept &= np.arange(len(e)) < COMPONENTS
        self.matrix = v[:, kept] / np.sqrt(e[kept])
        self.explained = e[kept] / np.trace(covariance) if kept.any() else e[kept]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n*x - S)^2 of each row, in whole numbers."""
        y = x - self.whole
        largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + 1
        if len(self.sums) * (self.n * largest) ** 2 < 1 << 63:
            return ((self.n * y - self.left) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - self.left.astype(object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def covariance(centred: DataFrame, n: int) -> np.ndarray:
    """Of one column of exactly centred arrays, divisor n."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(centred.columns[0]).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray() / n


def fit(vectors: DataFrame) -> Fit | None:
    """From a written frame of different vectors ``x``; None if there are none."""
    n = vectors.count()
    sums = [r["s"] for r in vectors.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s")).orderBy("k").collect()]
    if not n or not sums:
        return None
    sums = [int(s) for s in sums]
    whole, left = (np.array(f, t) for f, t in (([s // n for s in sums], np.int64), ([(s % n) / n for s in sums], np.float64)))
    shifted = F.zip_with("x", _numbers(whole), lambda a, b: a - b)
    return Fit(n, sums, covariance(vectors.select(F.zip_with(shifted, _numbers(left), lambda a, b: a.cast("double") - b).alias("y")), n))


def identity_error(vectors: DataFrame, found: Fit) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    size = found.matrix.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                w = found.centred(np.stack(batch["x"].to_numpy())) @ found.matrix
                total += w.T @ w
        yield pd.DataFrame({"k": np.arange(size * size), "g": total.ravel()})

    parts = vectors.select("x").mapInPandas(run, "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").toPandas()
    return float(np.abs(parts["g"].to_numpy().reshape(size, size) / found.n - np.eye(size)).max())


def whiten(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of each finite vector and component."""
    spark = rows.sparkSession
    bound_batches(spark)
    good = rows.where(finite(F.col(vector)))
    length = good.agg(F.max(F.size(vector))).first()[0] or 0
    good = good.select(F.col(ident).cast("long").alias("vec_id"), on_grid(F.col(vector), length).alias("x"))
    vectors = Scratch(spark, "whitening").save(good.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    found = fit(vectors)
    if found is None or not found.matrix.shape[1]:
        return spark.createDataFrame([], _OUT)
    off, size = identity_error(vectors, found), found.matrix.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 13):
                part = batch.iloc[at : at + (1 << 13)]
                x = np.stack(part["x"].to_numpy())
                ids = part["vec_id"].astype("Int64").repeat(size).reset_index(drop=True)
                deviation = pd.Series(found.deviations(x), dtype="Int64").repeat(size).reset_index(drop=True)
                yield pd.DataFrame({
                    "vec_id": ids,
                    "component": np.tile(np.arange(1, size + 1, dtype=np.int32), len(part)),
                    "n": np.int64(found.n),
                    "deviation": deviation,
                    "whitened": (found.centred(x) @ found.matrix).ravel(),
                    "explained": np.tile(found.explained, len(part)),
                    "identity_error": off,
                })

    return good.mapInPandas(run, _OUT)
