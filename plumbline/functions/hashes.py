"""Hashes whose values matter: 64-bit FNV-1a ids and CRC-32C checksums, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a, and the reversed polynomial of CRC-32C.
BASIS, PRIME, POLYNOMIAL = 0xCBF29CE484222325, 0x100000001B3, 0x82F63B78


def fnv1a(data: bytes) -> int:
    h = BASIS
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h


@cache
def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


def crc32c(data: bytes) -> int:
    table, h = _table(), 0xFFFFFFFF
    for b in data:
        h = h >> 8 ^ table[(h ^ b) & 255]
    return h ^ 0xFFFFFFFF


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            # Keys repeat; each different one is hashed once for each batch.
            codes, different = pd.factorize(part, use_na_sentinel=True)
            found = np.array([f(x.encode()) for x in different], np.int64)
            yield pd.Series([None if c < 0 else int(found[c]) for c in codes], dtype="Int64")

    return run


def id_of(text: Column) -> Column:
    """The FNV-1a hash without its lowest bit, moved down: a positive long."""
    return _each(lambda raw: fnv1a(raw) >> 1, "long")(text)


def checksum32c(text: Column) -> Column:
    """CRC-32C of the UTF-8 bytes, as a long."""
    return _each(crc32c, "long")(text)
