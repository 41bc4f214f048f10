"""Light scans of source text and tool output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.position import utf16_length

# Words of top-level declarations.
MODIFIERS = "private protected final sealed abstract case open implicit lazy override inline transparent".split()
KEYWORDS = "object class trait enum def val var type".split()
_DECL = rf"^((?:(?:{'|'.join(MODIFIERS)})\s+)*)({'|'.join(KEYWORDS)})(\s+)([A-Za-z_][A-Za-z0-9_$]*)"
TAIL_LINES, TAIL_CHARS = 10, 2000


def top_level_decls(docs: DataFrame) -> DataFrame:
    """(doc_id, line, keyword, name, start, end) of declarations in column 0; columns are UTF-16."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "content")).where(F.rlike("content", F.lit(_DECL)))
    part = lambda n: F.regexp_extract("content", _DECL, n)
    start = utf16_length(F.concat(part(1), part(2), part(3)))
    return rows.select("doc_id", "line", part(2).alias("keyword"), part(4).alias("name"), start.alias("start"), (start + F.length(part(4))).alias("end"))


def unsaved_only(decls: DataFrame, known: DataFrame, query: str) -> DataFrame:
    """Declarations whose name holds the query, in any case, and is not among the known display names."""
    hit = F.contains(F.lower("name"), F.lit(query.lower()))
    return decls.where(hit).join(known.select(F.col("display").alias("name")).distinct(), "name", "left_anti")


def missing_symbol(message: Column) -> Column:
    """X of ``Not found: X`` and ``Not found: type X``; null for others."""
    return F.nullif(F.regexp_extract(message, r"^Not found: (?:type )?([\p{L}\p{N}_$]+)", 1), F.lit(""))


def not_implemented(message: Column) -> Column:
    return F.contains(message, F.lit("needs to be abstract")) | F.contains(message, F.lit("object creation impossible"))


def kind_allowed(kind: Column, only: Column) -> Column:
    """A kind passes under itself and under what it continues behind a dot; no list or an empty filter passes all."""
    return only.isNull() | F.exists(only, lambda f: (f == "") | (kind == f) | F.startswith(kind, F.concat(f, F.lit("."))))


def stderr_tail(text: Column) -> Column:
    """The last lines that say something."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.rtrim(x))
    said = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit(r"^(Picked up |Downloading |Downloaded |\s*at )")))
    last = F.array_join(F.slice(said, F.greatest(F.size(said) - TAIL_LINES + 1, F.lit(1)), TAIL_LINES), "\n")
    short = F.when(F.length(last) > TAIL_CHARS, F.concat(F.lit("…"), F.right(last, F.lit(TAIL_CHARS)))).otherwise(last)
    return F.when(F.size(said) == 0, "(no stderr)").otherwise(short)


def _middle(x: list, y: list, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int, int]:
    """(differences, from, to): the middle snake of a shortest script between x[a:b] and y[c:d], by greedy paths from both ends."""
    n, m = b - a, d - c
    delta, odd = n - m, (n - m) & 1
    ahead, back = {1: 0}, {1: 0}
    for k in range((n + m + 1) // 2 + 1):
        for diagonal in range(-k, k + 1, 2):
            i = ahead[diagonal + 1] if diagonal == -k or diagonal != k and ahead[diagonal - 1] < ahead[diagonal + 1] else ahead[diagonal - 1] + 1
            j = i - diagonal
            start = i, j
            while i < n and j < m and x[a + i] == y[c + j]:
                i, j = i + 1, j + 1
            ahead[diagonal] = i
            other = delta - diagonal
            if odd and -k < other < k and i + back[other] >= n:
                return 2 * k - 1, a + start[0], c + start[1], a + i, c + j
        for diagonal in range(-k, k + 1, 2):
            i = back[diagonal + 1] if diagonal == -k or diagonal != k and back[diagonal - 1] < back[diagonal + 1] else back[diagonal - 1] + 1
            j = i - diagonal
            start = i, j
            while i < n and j < m and x[b - 1 - i] == y[d - 1 - j]:
                i, j = i + 1, j + 1
            back[diagonal] = i
            other = delta - diagonal
            if not odd and -k <= other <= k and i + ahead[other] >= n:
                return 2 * k, b - i, d - j, b - start[0], d - start[1]
    raise AssertionError("paths from both ends meet")


def common_lines(x: list, y: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order; memory follows the lengths, not their product."""
    out: list[tuple[int, int]] = []
    todo: list[tuple[int, int, int, int, bool]] = [(0, len(x), 0, len(y), False)]
    while todo:
        a, b, c, d, same = todo.pop()
        if same:
            out += zip(range(a, b), range(c, d))
            continue
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and x[b - 1 - tail] == y[d - 1 - tail]:
            tail += 1
        todo.append((b - tail, b, d - tail, d, True))
        b, d = b - tail, d - tail
        if a < b and c < d:
            _, i, j, u, v = _middle(x, y, a, b, c, d)
            todo += [(u, b, v, d, False), (i, u, j, v, True), (a, i, c, j, False)]
    return out


def line_edits(a: str, b: str) -> list[tuple[int, int, str]]:
    """(first line, lines removed, text) that turn one text into another, with as few lines removed and added as can be."""
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    out, i, j = [], 0, 0
    for u, v in [*common_lines(x, y), (len(x), len(y))]:
        if (i, j) != (u, v):
            out.append((i, u - i, "".join(y[j:v])))
        i, j = u + 1, v + 1
    return out


def minimal_edits(a: str, b: str) -> Column:
    """``line_edits`` of two columns, in Arrow batches."""

    @F.pandas_udf("array<struct<line:int,removed:int,text:string>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([[{"line": i, "removed": n, "text": t} for i, n, t in line_edits(p or "", q or "")] for p, q in zip(x, y)])

    return run(a, b)
