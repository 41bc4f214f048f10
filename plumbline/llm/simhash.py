"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits.  Two fingerprints within ``THRESHOLD`` bits agree
within t_i bits on one of the ``BLOCKS`` blocks, where the sum of (t_i + 1) is
THRESHOLD + 1.  Each block has a covering code as its anchors: the Hamming code
of 15 bits, times all values of the block's other bits, so that every point
lies within one bit of exactly one anchor, its home.  A fingerprint goes to its
home and to every anchor within 1 + t_i bits; a pair within t_i bits therefore
meets at the home of either, and whole fingerprints are compared there.  The
guarantee is exact: no bucket is capped.

Only different fingerprints are compared, each with its smallest document, so
groups of equal texts cost one row.  Buckets are compared as arrays; a large
one by a search that drops what it has reached, so a tight cluster of near
copies takes one pass and not all its pairs.  What leaves a task is a spanning
forest of its links.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, and is linked like any other; equal rows are one document;
rows with a null doc_id keep their fingerprint and component, which is then the
smallest id there is among the linked, or null; columns other than doc_id and
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import among, without_texts
from plumbline.llm.text import bound_batches, forest, sliced, words
from plumbline.plans.components import connected_components
from plumbline.runtime import Scratch

WIDTH, SEED, SHINGLE, THRESHOLD, BLOCKS = 64, 42, 4, 4, 3
_FLUSH = 1 << 18
_LARGE, _PAIRS = 512, 500_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle, repeats included; the whole sequence if there are fewer words."""
    found = words(text)
    if not found:
        return []
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    line, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return [h(line, SEED)]
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is set in over half the shingle hashes."""
    ones, total = np.zeros((len(texts), WIDTH), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = np.cumsum([0, *(len(x) for x in held)])
            for k, i in enumerate(owner):
                ones[i] += bits[at[k] : at[k + 1]].sum(axis=0, dtype=np.int64)
            held.clear()
            owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        found = np.array(shingle_hashes(text, size), np.uint64)
        total[i] = len(found)
        for part in range(0, len(found), _FLUSH):
            held.append(found[part : part + _FLUSH])
            owner.append(i)
            waiting += len(held[-1])
            if waiting >= _FLUSH:
                flush()
                waiting = 0
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = fingerprints(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(batch.column(c) for c in batch.schema.names[2:]), pa.array(prints.view(np.int64))], ["doc_id", *batch.schema.names[2:], "fp"])


def layout(threshold: int, blocks: int) -> list[tuple[int, int, int]]:
    """(shift, bits, t) of each block; the blocks cover the fingerprint, and the (t + 1) add up to threshold + 1."""
    spare, width = threshold + 1 - blocks, WIDTH // blocks
    if spare < 0 or width < 15:
        raise ValueError(f"{blocks} blocks do not suit a threshold of {threshold}")
    return [(i * width, width if i < blocks - 1 else WIDTH - i * width, spare // blocks + (i < spare % blocks)) for i in range(blocks)]


@cache
def steps(bits: int, reach: int) -> tuple[np.ndarray, ...]:
    """For each syndrome, what to flip to come to each anchor within ``reach`` bits; the home comes first."""
    found: list[dict[int, int]] = [{} for _ in range(16)]
    for n in range(reach + 1):
        for flips in combinations(range(bits), n):
            syndrome = 0
            for i in flips:
                syndrome ^= i + 1 if i < 15 else 0
            found[syndrome].setdefault(sum(1 << i for i in flips), n)
    home = [1 << (s - 1) if s else 0 for s in range(16)]
    return tuple(np.array([home[s], *(m for m in found[s] if m != home[s])], np.uint64) for s in range(16))


def syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i in range(15):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _replicate(threshold: int, blocks: int):
    plan = layout(threshold, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, reps = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy(zero_copy_only=False)
            for k, (shift, bits, t) in enumerate(plan):
                value = (prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                syndrome = syndromes(value)
                for s in range(16):
                    rows = np.flatnonzero(syndrome == s)
                    if not len(rows):
                        continue
                    flips = steps(bits, 1 + t)[s] if t else steps(bits, 1)[s][:1]
                    anchor = ((value[rows][:, None] ^ flips[None, :]) | np.uint64(k << 58)).ravel().view(np.int64)
                    which = np.repeat(rows, len(flips))
                    home = np.tile(np.arange(len(flips)) == 0, len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[which].view(np.int64)), pa.array(reps[which]), pa.array(home)], ["anchor", "fp", "rep", "home"])

    return run


def reached(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row numbers, that connect what is connected in one bucket; rows that a search has reached are compared no more."""
    left = np.arange(len(prints))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, fresh = 0, []
            while at < len(front) and len(left):
                part = front[at : at + max(1, _PAIRS // len(left))]
                at += len(part)
                near = np.bitwise_count(prints[part][:, None] ^ prints[left][None, :]) <= threshold
                hit = near.any(axis=0)
                if hit.any():
                    a.append(left[hit])
                    b.append(part[near[:, hit].argmax(axis=0)])
                    fresh.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(fresh) if fresh else front[:0]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(threshold: int):
    def links(anchor: np.ndarray, prints: np.ndarray, reps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of whole buckets, in order of their anchors."""
        edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[edge, len(anchor)])
        a, b = [], []
        for s, n in zip(edge[size > _LARGE], size[size > _LARGE]):
            i, j = reached(prints[s : s + n], threshold)
            a.append(reps[s + i])
            b.append(reps[s + j])
        first, count = np.repeat(edge, size), np.repeat(size, size)
        rows = np.flatnonzero(home & (count > 1) & (count <= _LARGE))
        done = np.cumsum(count[rows])
        for part in np.split(rows, np.searchsorted(done, np.arange(_PAIRS, int(done[-1]), _PAIRS)) if len(rows) else []):
            left = np.repeat(part, count[part])
            skip = np.cumsum(count[part]) - count[part]
            right = np.repeat(first[part] - skip, count[part]) + np.arange(len(left))
            near = np.bitwise_count(prints[left] ^ prints[right]) <= threshold
            near &= left != right
            a.append(reps[left[near]])
            b.append(reps[right[near]])
        none = np.zeros(0, np.int64)
        return forest(np.concatenate([none, *a]), np.concatenate([none, *b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "rep", "home")]
            now = got if rest is None else [np.concatenate(x) for x in zip(rest, got)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                u, v = links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut], now[3][:cut])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if rest is not None and len(rest[0]):
            u, v = links(rest[0], rest[1].view(np.uint64), rest[2], rest[3])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _links(different: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """``(u, v)``: the reps of linked fingerprints, of rows (fp, rep)."""
    spread = different.mapInArrow(_replicate(threshold, blocks), "anchor long, fp long, rep long, home boolean")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; fp is the fingerprint as a signed long.

    ``blocks``: more bits in each block give more anchors with fewer rows at
    each, and more copies of a fingerprint; 3 suits up to about 10**8 different
    fingerprints, 2 more than that.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    different = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "different")
    links = _links(different.where("rep is not null"), threshold, blocks)
    found = connected_components(links, label="simhash-components")
    classes = different.join(found, different["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(scratch.save(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first document of each component, as it is; a document is a doc_id with a text, and of equal ones one row stays.

    Components are those of the fingerprints themselves, so rows that share a
    doc_id, or have none, are neither linked nor removed by that; rows without
    an id come last, and by the hash of their text among each other.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    prints = scratch.save(hashed.mapInArrow(_fingerprint_batches, "doc_id long, h long, fp long"), "fingerprints")
    different = scratch.save(prints.select("fp", F.col("fp").alias("rep")).distinct(), "different")
    linked = connected_components(_links(different, THRESHOLD, BLOCKS), label="simhash-components")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x"))
    groups = first.join(linked, first["fp"] == linked["node"], "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("x").alias("x"))
    chosen = scratch.save(groups.select("x.doc_id", "x.h"), "chosen")
    kept = among(docs, chosen)
    copies = prints.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h")
    again = scratch.save(copies.join(chosen.toDF("i", "j"), F.expr("doc_id <=> i and h = j"), "left_semi"), "again")
    if again.isEmpty():
        return kept
    return without_texts(kept, again).unionByName(among(kept, again).dropDuplicates(["doc_id", "text"]))
