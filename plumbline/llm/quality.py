"""Quality rules with host-level verdicts.

Every document gets its counts and the number of soft rules that it fails.
Per host (column ``source``) the failures are summed, one partial sum in each
task, so a host with a third of all rows costs one row of each task.  The
hosts' rates of failing documents are shrunk toward a beta prior whose two
parameters are fitted to all hosts by the method of moments.  The verdict
comes back by a join on the host: a document of a host whose shrunk rate is
over ``HOST_RATE`` must pass all soft rules, any other may fail the rule on
repeated lines.  A clean document of a bad host therefore stays.

Defined cases: a null text has no words and fails the base rules; a null host
counts as the host ''; equal rows are judged alike; rows keep their columns;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import near
from plumbline.llm.text import bound_batches, sliced, words
from plumbline.runtime import Scratch

MIN_WORDS, REPEAT_SHARE, HOST_RATE, SPARE = 50, 50, 0.5, 1
#: Soft rules: symbols for each 100 words (2 points), repeated lines in 100 (1 point), mean characters of a word (2 points).
SYMBOLS, LINES, SHORT, LONG = 30, 30, 2, 15
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_soft"]
_GAPS, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def repeat_words(found: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    n = len(found) - 2
    if n < 2:
        return 0
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    if len(number) < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    else:
        grams = list(zip(found, found[1:], found[2:]))
        seen = Counter(grams)
        twice = np.fromiter((seen[g] > 1 for g in grams), bool, n)
    cover = np.zeros(len(found), bool)
    for k in range(3):
        cover[k : n + k] |= twice
    return int(cover.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``."""
    text = text or ""
    found = words(text, lower=False)
    chars = len(text) - sum(map(text.count, _GAPS))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_GAPS)]
    copies = len(lines) - len(set(lines))
    n = len(found)
    soft = 2 * (100 * symbols > SYMBOLS * n) + (100 * copies > LINES * len(lines)) + 2 * (not SHORT * n <= chars <= LONG * n)
    return n, chars, symbols, copies, repeat_words(found), soft


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of every row, and after them the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            rows = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            found = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [f"c{k}" for k in range(batch.num_columns - 1 + len(found))])

    bound_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    given = [f"c{k} {kinds[c]}" for k, c in enumerate(columns)]
    more = [f"c{k} long" for k in range(len(columns), len(columns) + len(_COUNTS))]
    plain = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), F.col("text").alias("t"))
    return plain.mapInArrow(run, ", ".join([*given, *more]))


def base_failed(n_words: str, n_repeat: str):
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > REPEAT_SHARE * F.col(n_words))


def host_verdicts(counted: DataFrame) -> DataFrame:
    """``(host, bad)`` from rows of (host, failed)."""
    hosts = counted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    fit = hosts.agg(F.avg(F.col("f") / F.col("n")).alias("m"), F.var_pop(F.col("f") / F.col("n")).alias("v")).first()
    mean, spread = fit["m"] or 0.0, fit["v"] or 0.0
    weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    return hosts.select("host", ((mean * weight + F.col("f")) / (weight + F.col("n")) > HOST_RATE).alias("bad"))


def judge(docs: DataFrame, columns: list[str], host: str = "source") -> DataFrame:
    """The given columns and, each with ``#`` before its name, the counts, ``base_failed`` and ``kept`` of every row.

    Columns and counts are written once in the shared folder; the hosts' sums
    and the join with their verdicts read them there, so no text is measured twice
    or shuffled.
    """
    k = len(columns)
    rows = measured(docs, [*columns, host])
    rows = rows.withColumnsRenamed({f"c{k}": "#host"} | {f"c{k + 1 + i}": f"#{c}" for i, c in enumerate(_COUNTS)})
    rows = rows.withColumn("#host", F.coalesce("#host", F.lit(""))).withColumn("#base_failed", base_failed("#n_words", "#n_repeat_words"))
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(rows, "counts")
    hosts = host_verdicts(rows.select(F.col("#host").alias("host"), (F.col("#base_failed") | (F.col("#n_soft") > SPARE)).alias("failed")))
    hosts = near(scratch.save(hosts, "hosts"))
    rows = rows.join(hosts.withColumnsRenamed({"host": "#its", "bad": "#bad"}), F.col("#host") == F.col("#its"), "left")
    kept = ~F.col("#base_failed") & (F.col("#n_soft") <= F.when(F.coalesce("#bad", F.lit(False)), 0).otherwise(SPARE))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), *(f"#{c}" for c in _COUNTS), "#base_failed", kept.alias("#kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, as they are."""
    return judge(docs, docs.columns).where("`#kept`").select(*docs.columns)
