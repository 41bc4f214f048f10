"""Search keys and fuzzy scores of display names, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Score tiers.
EXACT, PREFIX, SUBSEQUENCE, HUMP = 1_000_000, 100_000, 1_000, 1_000
_ALNUM = r"^[\p{L}\p{N}]$"


def normalize(name: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def humps(name: Column) -> Column:
    """(c, hump) for each letter or digit: a hump starts a word, an upper-case run or a number."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        before = F.coalesce(F.get(chars, i - 1), F.lit(" "))
        fresh = ~F.rlike(before, F.lit(_ALNUM))
        upper = F.rlike(c, F.lit(r"^\p{Lu}$")) & ~F.rlike(before, F.lit(r"^\p{Lu}$"))
        digit = F.rlike(c, F.lit(r"^\p{N}$")) & ~F.rlike(before, F.lit(r"^\p{N}$"))
        return F.struct(F.lower(c).alias("c"), (fresh | upper | digit).alias("hump"), F.rlike(c, F.lit(_ALNUM)).alias("own"))

    return F.filter(F.transform(chars, one), lambda x: x.own)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(humps(name), lambda x: x.hump), lambda x: x.c), "")


def hump_hits(query: str, marked: Column) -> Column:
    """Most query characters on humps over all embeddings of the query as a subsequence; null without one."""
    n = len(query)
    start = F.array(F.lit(0), *([F.lit(None).cast("int")] * n))

    def step(best: Column, x: Column) -> Column:
        hit = F.when(x.hump, 1).otherwise(0)
        return F.array(best[0], *(F.when(x.c == query[j - 1], F.greatest(best[j], best[j - 1] + hit)).otherwise(best[j]) for j in range(1, n + 1)))

    return F.aggregate(marked, start, step, lambda best: best[n])


def score(query: str, name: Column) -> Column:
    """Exact before prefix before subsequence; shorter names first; null if the query is no subsequence."""
    wanted = "".join(c for c in query if c.isalnum()).lower()
    if not wanted:
        return F.lit(None).cast("int")
    plain = normalize(name)
    size = F.length(plain)
    other = F.lit(SUBSEQUENCE) + hump_hits(wanted, humps(name)) * HUMP - size
    return F.when(size == 0, None).when(plain == wanted, F.lit(EXACT) - size).when(F.startswith(plain, F.lit(wanted)), F.lit(PREFIX) - size).otherwise(other)


def field_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)


def matches_member(query: str, name: str) -> bool:
    """Member search: other characters than lower-case ones may skip ahead to their match; a lower-case mismatch goes back to just behind the last aligned upper-case pair."""
    i = j = 0
    upper_q = upper_n = None
    while i < len(query):
        if j == len(name):
            return False
        q = query[i]
        if q == name[j]:
            if q.isupper():
                upper_q, upper_n = i, j
            i, j = i + 1, j + 1
            continue
        if not q.islower():
            j += 1
            continue
        if upper_q is None:
            return False
        i, j, upper_q, upper_n = upper_q, upper_n + 1, None, None
    return True


def member_match(query: str):
    """A vectorised column function of names."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in parts:
            yield names.map(lambda n: n is not None and matches_member(query, n))

    return run
