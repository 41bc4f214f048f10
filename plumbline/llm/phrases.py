"""Phrase collocations from word-id suffix arrays.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
into words at spaces and tabs.  A task puts the words of each language into
shards of ``SHARD`` words, numbered by the shard itself, with a separator
between pieces.  A shard's suffixes are ordered by numpy prefix doubling (by
one, two, four and five words); runs of neighbours whose common prefix has k
words or more are the LCP intervals, and their lengths the counts of the
k-word phrases.  Spark merges the counts of all shards by language and phrase.

Three passes keep what is merged small without losing a phrase: a phrase can
occur ``least`` times only if its words and its pairs of words do.  The words
are counted first, then the pairs of frequent words, then the phrases whose
pairs are all frequent.  A pass learns what the pass before found frequent
from a bitmap of hashes of a fixed size (``WORD_BITS``, ``PAIR_BITS``), which
is broadcast; a collision lets more phrases through to the merge, never fewer,
and the merged counts decide.  All counts are of whole texts.

Defined cases: a null text is empty; a null language counts as ``und``; equal
rows count each time; a text of any length is cut into shards that overlap by
the words that a phrase may reach ahead; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import bound_batches, sliced
from plumbline.runtime import Scratch

#: Candidates: words of a phrase at most, occurrences at least; rows for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a shard, and the bits of the two bitmaps (2 MB and 8 MB).
SHARD, WORD_BITS, PAIR_BITS = 1 << 20, 24, 26
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_COUNTS = "lang string, phrase string, c long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, and ``.`` between its pieces."""
    return (text or "").encode().translate(_TABLE).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\t" + word)


def word_slots(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def pair_slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Places in the bitmap of pairs, from the hashes of their words."""
    return ((first * _ODD ^ (second << np.uint64(31) | second >> np.uint64(33))) * _ODD) >> np.uint64(64 - bits)


def bits_of(bitmap: np.ndarray) -> int:
    return len(bitmap).bit_length() + 5


def within(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1) == 1


def dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b) of numbers from 0, equal pairs alike, in their order."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def ahead(a: np.ndarray, k: int) -> np.ndarray:
    """The value k places on; 0, the separator, beyond the end."""
    return np.concatenate([a[k:], np.zeros(min(k, len(a)), a.dtype)])


def reach(ids: np.ndarray, most: int) -> np.ndarray:
    """Words from each place to the next separator, ``most`` at most."""
    found, open_ = np.zeros(len(ids), np.int8), np.ones(len(ids), bool)
    for k in range(most):
        open_ &= ahead(ids, k) > 0
        found += open_
    return found


def intervals(ids: np.ndarray, starts: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, places, counts)``: the phrases of low to high words (5 at most) that begin before ``starts``, by one of their places each.

    ids: word numbers from 1, with 0 between pieces.
    """
    span = reach(ids, high)
    one = ids
    two = dense(one, ahead(one, 1)) if high > 1 else one
    four = dense(two, ahead(two, 2)) if high > 2 else two
    last = dense(four, ahead(one, 4)) if high > 4 else four
    at = np.flatnonzero(span[:starts] >= low)
    at = at[np.argsort(last[at], kind="stable")]
    if not len(at):
        return
    third = ahead(one, 2)
    equal = {1: one, 2: two, 3: third, 4: four, 5: last}
    common = np.zeros(len(at), np.int8)  # words that a suffix shares with the one before
    alike = np.ones(len(at) - 1, bool)
    for k in range(1, high + 1):
        alike &= equal[k][at[1:]] == equal[k][at[:-1]]
        common[1:] += alike
    for k in range(low, high + 1):
        # A suffix shorter than k shares fewer than k words with any longer one, so it never lies inside an interval.
        first = np.flatnonzero(common < k)
        sizes = np.diff(np.append(first, len(at)))
        keep = span[at[first]] >= k
        if keep.any():
            yield k, at[first[keep]], sizes[keep]


class _Shards:
    """Words of each language as they come; what was filled goes out as counts."""

    def __init__(self, low: int, high: int, words: np.ndarray | None, pairs: np.ndarray | None, size: int):
        self.low, self.high, self.words, self.pairs, self.size = low, high, words, pairs, size
        self.held: dict[str, list[list[bytes]]] = defaultdict(list)
        self.sizes: dict[str, int] = defaultdict(int)

    def add(self, lang: str, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.held[lang].append(found)
        self.held[lang].append([b"."])
        self.sizes[lang] += len(found) + 1
        if self.sizes[lang] >= self.size:
            yield from self.flush(lang)
        elif sum(self.sizes.values()) >= 4 * self.size:
            yield from self.flush_all()

    def flush_all(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.held):
            yield from self.flush(lang)

    def flush(self, lang: str) -> Iterator[pa.RecordBatch]:
        held = self.held.pop(lang)
        self.sizes.pop(lang)
        stream = [w for x in held for w in x]
        for at in range(0, len(stream), self.size):
            yield from self.shard(lang, stream[at : at + self.size + self.high - 1], self.size)

    def shard(self, lang: str, stream: list[bytes], starts: int) -> Iterator[pa.RecordBatch]:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        number[b"."]
        ids = np.fromiter(map(number.__getitem__, stream), np.int64, len(stream))
        names = list(number)
        if self.words is None:
            counts = np.bincount(ids[:starts], minlength=len(names))
            counts[0] = counts[1:].sum()
            kept = np.flatnonzero(counts)
            names[0] = b""
            yield self.batch(lang, pa.array(names, pa.binary()).take(pa.array(kept)), counts[kept])
            return
        h = np.array([word_hash(lang, w) for w in names], np.uint64)
        known = within(self.words, word_slots(h, bits_of(self.words)))
        known[0] = False
        ids = np.where(known[ids], ids, 0)
        if self.pairs is not None:
            # A word stays with its neighbours only through frequent pairs: a separator goes where a pair is not.
            follows = np.zeros(len(ids), bool)
            follows[:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & within(self.pairs, pair_slots(h[ids[:-1]], h[ids[1:]], bits_of(self.pairs)))
            ids, starts = cut(ids, follows, starts)
        texts = pa.array(names, pa.binary())
        for k, places, counts in intervals(ids, starts, self.low, self.high):
            for i in range(0, len(places), 1 << 17):
                p = places[i : i + (1 << 17)]
                columns = [texts.take(pa.array(ids[p + j])) for j in range(k)]
                yield self.batch(lang, pc.binary_join_element_wise(*columns, b" "), counts[i : i + (1 << 17)])

    @staticmethod
    def batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int64))), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "c"])


def cut(ids: np.ndarray, follows: np.ndarray, starts: int) -> tuple[np.ndarray, int]:
    """Runs of places that each follow the one before, a separator after each run, single words left out; and how many of the new places lie before ``starts``."""
    inside = follows.copy()
    inside[1:] |= follows[:-1]
    at = np.flatnonzero(inside)
    ends = ~follows[at]
    to = np.arange(len(at)) + np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(at) else at
    out = np.zeros(len(at) + int(ends.sum()), np.int64)
    out[to] = ids[at]
    before = int(np.searchsorted(at, starts))
    return out, int(to[before]) if before < len(at) else len(out)


def counted(docs: DataFrame, low: int, high: int, words=None, pairs=None, shard: int = SHARD) -> DataFrame:
    """``(lang, phrase, c)`` of the phrases of low to high words that a shard has, one row for each shard; broadcasts say which words and pairs are frequent.  Of words, the row with the empty phrase counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(low, high, words and words.value, pairs and pairs.value, shard)
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    yield from shards.add(lang, tokens(text))
        yield from shards.flush_all()

    bound_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _COUNTS)


def merged(counts: DataFrame, least: int) -> DataFrame:
    """The phrases that all shards together have ``least`` times; the total of a language has no words and stays."""
    return counts.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.col("phrase") == ""))


def bitmap(frequent: DataFrame, bits: int, pairs: bool) -> np.ndarray:
    """The bitmap of frequent words or pairs: 2**bits bits, joined in 64-bit parts by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[word_hash(x["lang"], w) for w in x["phrase"].encode().split(b" ")] for x in batch.to_pylist()]
            h = np.array(found, np.uint64).reshape(len(found), 2 if pairs else 1)
            slots = pair_slots(h[:, 0], h[:, 1], bits) if pairs else word_slots(h[:, 0], bits)
            bit = np.left_shift(np.uint64(1), slots & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["slot", "bit"])

    parts = frequent.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[parts.column("slot").to_numpy()] = parts.column("bit").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD, bits: tuple[int, int] = (WORD_BITS, PAIR_BITS)) -> DataFrame:
    """``(lang, phrase, c)``, written: the phrases of up to ``longest`` words found ``least`` times or more, and each language's words, under the empty phrase."""
    if not 2 <= longest <= 5:
        raise ValueError("phrases have two to five words at most")
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    found = scratch.save(merged(counted(docs, 1, 1, shard=shard), least), "words")
    words = send(bitmap(found, bits[0], False))
    pairs = scratch.save(merged(counted(docs, 2, 2, words, shard=shard), least), "pairs")
    found = found.union(pairs)
    if longest > 2:
        known = send(bitmap(pairs, bits[1], True))
        found = found.union(scratch.save(merged(counted(docs, 3, longest, words, known, shard), least), "longer"))
    return found


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, **how) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A phrase of a = f(phrase) >= least is cut after each of its words into parts with
    l and r occurrences; its score is the lowest floor(1000 * a * n / (l * r)), at the
    first such cut.  Phrases that a longer one contains as often as they occur go.  how:
    ``shard`` and ``bits`` of ``phrase_counts``, which change no row.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    found = phrase_counts(docs, scratch, longest, least, **how)
    totals = found.where("phrase = ''").select(F.col("lang").alias("#lang"), F.col("c").alias("n"))
    found = found.where("phrase <> ''").withColumn("w", F.split("phrase", " "))
    size = F.size("w")
    # With the same count, a longer phrase that contains another holds it at an end of a phrase one word longer, as often.
    ends = F.array(F.array_join(F.slice("w", F.lit(1), size - 1), " "), F.array_join(F.slice("w", F.lit(2), size - 1), " "))
    covered = found.where(size > 2).select("lang", F.explode(F.array_distinct(ends)).alias("phrase"), "c").distinct()
    kept = found.where(size > 1).join(covered, ["lang", "phrase", "c"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("c").alias("a"), "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, size - F.col("cut")).alias("rest"))
    times = found.select("lang", "phrase", "c")
    cuts = cuts.join(times.toDF("lang", "first", "l"), ["lang", "first"]).join(times.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.join(totals, F.col("lang") == F.col("#lang"))
    whole = lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    score = F.expr("top div below")
    cuts = cuts.withColumn("top", whole(1000 * F.col("a"), F.col("n"))).withColumn("below", whole(F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of 64 parts of a language, then of all: no task sorts more than a part.
    parted = best.withColumn("#part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parted = parted.withColumn("#k", F.row_number().over(Window.partitionBy("lang", "#part").orderBy(*order))).where(F.col("#k") <= top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
