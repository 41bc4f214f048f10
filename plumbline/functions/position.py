"""Positions: packed line and character, spans, UTF-16 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES, CHARS = (1 << 20) - 1, (1 << 12) - 1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(line: Column | str, char: Column | str) -> Column:
    """One long that sorts by line, then character; both saturate."""
    return F.shiftleft(F.least(_c(line).cast("long"), F.lit(LINES)), 12).bitwiseOR(F.least(_c(char).cast("long"), F.lit(CHARS)))


def unpack_line(p: Column | str) -> Column:
    return F.shiftrightunsigned(_c(p), 12).cast("int")


def unpack_char(p: Column | str) -> Column:
    return _c(p).bitwiseAND(CHARS).cast("int")


def contains(ps: Column | str, pe: Column | str, at: Column | str) -> Column:
    """Start and end belong to the span."""
    return (_c(ps) <= _c(at)) & (_c(at) <= _c(pe))


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")
