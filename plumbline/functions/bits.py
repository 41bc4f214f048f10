"""Bit sets of small numbers, such as targets: arrays of 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def _width(members: Column, size: int | None) -> Column:
    return F.lit(-(-size // WORD)) if size else F.coalesce(F.floor(F.array_max(members) / WORD).cast("int") + 1, F.lit(0))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(WORD)).cast("int"))


def of(members: Column, size: int | None = None) -> Column:
    """The set of an array of numbers from 0; as many words as ``size`` numbers need, or as the largest needs."""
    words = F.when(_width(members, size) > 0, F.sequence(F.lit(0), _width(members, size) - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda w: F.filter(members, lambda m: F.floor(m / WORD) == w)
    return F.transform(words, lambda w: F.aggregate(own(w), F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(_bit(m))))


def all_of(size: int) -> Column:
    """Every number below ``size``."""
    full, rest = divmod(size, WORD)
    return F.array(*([F.lit(-1).cast("long")] * full + ([F.lit((1 << rest) - 1).cast("long")] if rest else []))).cast("array<bigint>")


def contains(words: Column, n: Column) -> Column:
    return F.coalesce(F.get(words, F.floor(n / WORD).cast("int")).bitwiseAND(_bit(n)) != 0, F.lit(False)) & (n >= 0)


def intersects(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y) != 0, F.lit(False))), lambda hit: hit)


def cardinality(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def members(words: Column) -> Column:
    """The numbers in the set, in order."""
    each = F.transform(words, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1).cast("long")) == 1), lambda b: i * WORD + b))
    return F.flatten(each)
