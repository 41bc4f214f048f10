"""Token counts of whole texts by a map-side two-tier lookup.

A text's tokens are the tokens of its pre-tokens, so a count is a sum of
lengths.  Tier one is a broadcast hash table from frequent pre-tokens to their
lengths, at most ``FREQUENT`` entries of at most ``LONGEST`` characters each:
about 8 MB at most, whatever the corpus.  It is taken from a bounded sample of
about ``SAMPLE`` documents; it only saves time and never changes a count.  Tier
two is a cache in each Python worker of at most ``CACHED`` entries, filled by
the tokenizer library.  No pre-token is shuffled.

The library splits a text at the strings of added tokens first; each is one
token.  Its Unicode tables may differ from those of the regex library in
recently assigned characters: the driver compares the classes of the two over
all code points, in under a second, and texts that hold such a character are counted by the library as a whole.

Defined cases: a null text counts as empty, an empty text has no tokens, equal
rows give equal rows, further columns are not read, an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import bound_batches, sliced

FREQUENT, LONGEST, CACHED, SAMPLE = 1 << 16, 24, 1 << 18, 4096

# The pre-token pattern of byte-level BPE.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    return Tokenizer.from_file(path)


@cache
def added(path: str) -> regex.Pattern | None:
    """The strings that the library turns into one token each before all else."""
    found = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


@cache
def unlike() -> str:
    """A character class of what the two libraries put in different classes of ``PRETOKEN``; empty if nothing."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    found: set[int] = set()
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 4096):
        block = "".join(map(chr, points[low : low + 4096]))
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            ours, theirs = regex.sub(kind, "\0", block), Replace(Regex(kind), "\0").normalize_str(block)
            if ours != theirs:
                found.update(c for c, x, y in zip(points[low:], ours, theirs) if x != y)
    ranges: list[list[int]] = []
    for c in sorted(found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, and behind it what this worker has met."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent, self.library = frequent, tokenizer(path)

    def fill(self, found: set[str]) -> None:
        """Adds what is new, encoded together; without long ones, and all but the frequent ones are forgotten where there are too many."""
        if len(self) >= len(self.frequent) + CACHED:
            self.clear()
            self.update(self.frequent)
        new = [x for x in found if x not in self and len(x) <= 64]
        self.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))

    def __missing__(self, key: str) -> int:
        return len(self.library.encode(key, add_special_tokens=False).ids)


_workers: dict[str, Lengths] = {}


def counts(texts: list[str], path: str, lengths: Lengths, odd: regex.Pattern | None) -> list[int]:
    """Tokens of each text."""
    marks, split = added(path), regex.compile(PRETOKEN).findall
    totals, parts = [0] * len(texts), []
    for k, text in enumerate(texts):
        found, at = [], 0
        if odd and odd.search(text):
            totals[k] = len(tokenizer(path).encode(text, add_special_tokens=False).ids)
        else:
            for m in marks.finditer(text) if marks else ():
                totals[k] += 1
                found += split(text[at : m.start()])
                at = m.end()
            found = found + split(text[at:]) if at else split(text)
        parts.append(found)
    lengths.fill(set().union(*parts))
    return [n + sum(map(lengths.__getitem__, found)) for n, found in zip(totals, parts)]


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE) -> dict[str, int]:
    """Tier one, from about ``sample`` documents spread over the table."""
    n = docs.count()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(PRETOKEN).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(x for x in split(text or "") if len(x) <= LONGEST)
            if len(seen) > 8 * FREQUENT:
                seen = Counter(dict(seen.most_common(FREQUENT)))
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"])

    seen = docs.select("text").sample(min(1.0, sample / max(n, 1)), seed=1).mapInArrow(tally, "piece string, n long")
    top = seen.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()
    pieces = [r["piece"] for r in top]
    return dict(zip(pieces, map(len, tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False))))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; ``path``: a byte-level BPE of the tokenizers library."""
    bound_batches(docs.sparkSession)
    odd_class = unlike()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers or _workers[path].frequent is not frequent.value:
            _workers[path] = Lengths(path, frequent.value)
        lengths, odd = _workers[path], regex.compile(f"[{odd_class}]") if odd_class else None
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = counts(texts, path, lengths, odd)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
