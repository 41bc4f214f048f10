"""Repeated passages: bytes covered by a 100-byte string that also starts earlier.

Anchors find where to look, and lose nothing.  Among the ``K``-byte strings of
each 100-byte window the one with the least hash is the window's anchor; equal
windows have equal anchors at equal places.  Neighbouring windows with one
anchor are a run, about one for every 31 bytes.  Runs meet by the hash of their
anchor; a run that stands alone holds no repeated window, and of runs that are
equal as a whole all but the first are repeats.  Equal runs are reduced to one
in each task before that shuffle, so hot passages cost a row of each task.

What is left are runs that share an anchor but differ: about one byte in a
hundred.  Their texts go to shards by anchor and are decided by suffix order: each
task sorts its shard by external induced sorting (see ``induced``), whose queues
go to disk, and walks the order; neighbours in it that share 100 bytes are equal
windows, and all but the earliest are repeats.  Only prefixes of that length
matter, so the common prefix is compared there, not carried through the
induction.  The runs of an anchor with more than ``HEAVY`` different ones are
dealt by window, by the bytes at both ends of it, so no anchor fills a task.
Inside an anchor, windows are told apart by the ``SIDE`` bytes before it or
behind it, and those with nothing to compare are not sorted: lines that many
texts share but that are shorter than 100 bytes fall away here.

Positions are (doc_id, start); a string starts earlier if its position is
smaller.  Rows that share a doc_id are one document with several texts, told apart
by a 64-bit hash of the text and 20 bits of its checksum: none of several equal strings at
one place comes first, and equal texts lose the same bytes.  Defined cases: a null text counts as empty; a null
doc_id sorts first; texts under 100 bytes keep all; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.induced import byte_order
from plumbline.llm.text import bound_batches, sliced
from plumbline.runtime import Scratch

SIZE, K, SIDE, HEAVY, PART, SHARD = 100, 40, 30, 1 << 16, 1 << 20, 1 << 20
#: Rows of spans, 40 bytes each on average, that are broadcast at most; more are joined by a shuffle.
BROADCAST_SPANS = 1_000_000
_WINDOWS = SIZE - K + 1
_BASE, _LEAST = 0x9E3779B97F4A7C15, -(1 << 63)
_TAG = (1 << 20) - 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]).astype(np.uint64) for x in (_BASE, back))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of all the run's bytes, first window, anchor behind the last window, windows) of at most PART + SIZE bytes."""
    n = len(raw)
    up, down = _powers(PART + SIZE)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(raw.astype(np.uint64) + np.uint64(1)) * up[:n])]).astype(np.uint64)
    keys = _mix((sums[K:] - sums[:-K]) * down[: n - K + 1])
    last = n - SIZE + 1
    pad = np.full(-len(keys) % _WINDOWS, np.uint64(2**64 - 1))
    rows = np.concatenate([keys, pad]).reshape(-1, _WINDOWS)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:last], ahead[_WINDOWS - 1 : _WINDOWS - 1 + last])
    edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    stop = np.r_[edge[1:], last]
    # A run has one anchor, the leftmost of equal ones: it is cut where that falls out of the window.
    anchor = edge + (keys[np.minimum(edge[:, None] + np.arange(_WINDOWS), len(keys) - 1)] == least[edge][:, None]).argmax(axis=1)
    more = []
    for e, z in zip(edge[stop > anchor + 1], stop[stop > anchor + 1]):
        equal = e + np.flatnonzero(keys[e : z + _WINDOWS - 1] == least[e])
        more.append(equal[equal < z - 1] + 1)
    if more:
        edge = np.unique(np.concatenate([edge, *more]))
    size = np.diff(np.r_[edge, last])
    final = edge + size - 1
    behind_last = (keys[np.minimum(final[:, None] + np.arange(_WINDOWS), len(keys) - 1)] == least[edge][:, None]).argmax(axis=1)
    whole = _mix((sums[edge + size + SIZE - 1] - sums[edge]) * down[edge]) ^ size.astype(np.uint64)
    return least[edge], whole, edge, behind_last, size


def _pack(start: np.ndarray, tag: np.ndarray, ahead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, then 20 bits of the text's checksum, 6 of the anchor's distance from the last window, 6 of the number of windows less one: sorts by start."""
    return start.astype(np.int64) << 32 | tag.astype(np.int64) << 12 | ahead.astype(np.int64) << 6 | (size.astype(np.int64) - 1)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, waiting
        a, c, d, h, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((h, at, d, c, a))
        a, c, d, h, at = a[order], c[order], d[order], h[order], at[order]
        again = np.r_[False, (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & ((d[1:] != d[:-1]) | (at[1:] >> 32 != at[:-1] >> 32))]
        again |= _same_place(a, c, d, at, again)
        a = np.where(again, _mix(d.view(np.uint64) ^ at.view(np.uint64)), a)
        held, waiting = [], 0
        return pa.RecordBatch.from_arrays([pa.array(again), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(h), pa.array(at)], ["done", "a", "c", "d", "h", "at"])

    for batch in sliced(batches):
        for d, h, tag, text in zip(*(batch.column(x).to_pylist() for x in ("d", "h", "tag", "text"))):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            for low in range(0, len(raw) - SIZE + 1, PART):
                a, c, s, ahead, n = runs(raw[low : low + PART + SIZE - 1])
                held.append([a, c, np.full(len(a), d), np.full(len(a), h), _pack(s + low, np.full(len(a), tag), ahead, n)])
                waiting += len(a)
                if waiting > 1 << 19:
                    yield flush()
    if held:
        yield flush()


def _same_place(a: np.ndarray, c: np.ndarray, d: np.ndarray, at: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Rows at the place of the row before them, in the same class: repeats if that one is."""
    out = np.zeros(len(a), bool)
    for k in np.flatnonzero(np.r_[False, (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & ~again[1:]]).tolist():
        out[k] = again[k - 1] or out[k - 1]
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (done, a, c, d, at) to (open, a, d, h, at): repeats, and the first of each class where an anchor has several.

    Different texts of one doc_id may have equal runs at one place; none of them comes first, and all are given out.
    """

    def rows(found: np.ndarray, which: np.ndarray, open_: bool) -> pa.RecordBatch:
        a, d, h, at = found[[0, 2, 3, 4]][:, which]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), open_)), pa.array(a), pa.array(d), pa.array(h), pa.array(at)], ["open", "a", "d", "h", "at"])

    held, given = np.zeros((5, 0), np.int64), False  # the last class so far: its first rows, and whether they have been given out
    for batch in batches:
        done = batch.column("done").to_numpy(zero_copy_only=False)
        found = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "c", "d", "h", "at")])
        if done.any():
            yield rows(found, done, False)
        found = found[:, ~done]
        if not found.shape[1]:
            continue
        carried = held.shape[1]
        found = np.hstack([held, found])
        a, c, d, _, at = found
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))
        repeat = (d != d[first]) | (at >> 32 != at[first] >> 32)
        group = np.cumsum(new_a) - 1
        several = np.bincount(group, weights=new_c)[group] > 1
        if carried and given:
            several |= group == 0
        opened = ~repeat & several
        mine = np.arange(len(a)) >= carried
        if given:
            opened &= mine
        yield rows(found, repeat & mine, False)
        yield rows(found, opened, True)
        waiting = np.flatnonzero(~repeat & (first == first[-1]))
        given = bool(several[-1])
        if not given and len(waiting) > 1 << 20:
            # So many are given out unasked, which decides nothing, rather than held.
            yield rows(found, waiting, True)
            given = True
        held = found[:, waiting[:1] if given else waiting]


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of open runs, by shard key: windows that hold SIDE bytes before the anchor by those, the others by the SIDE bytes behind it; windows of heavy anchors one by one."""
    out: list[tuple[int, int, int, int, bytes]] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["key", "d", "h", "at", "raw"])

    for batch in sliced(batches):
        for d, h, text, found in zip(*(batch.column(x).to_pylist() for x in ("d", "h", "text", "runs"))):
            raw = (text or "").encode()
            for r in found:
                start, low = r["at"] >> 32, r["at"] & 0xFFFFFFFF
                stop, tag, anchor = start + (low & 63) + 1, low & ~4095, r["a"].to_bytes(8, "little", signed=True)
                at = stop - 1 + (low >> 6 & 63)
                if r["heavy"]:
                    for s in range(start, stop):
                        out.append((_key(anchor, raw[s : s + 8], raw[s + SIZE - 8 : s + SIZE]), d, h, s << 32 | tag, raw[s : s + SIZE]))
                else:
                    middle = max(start, min(stop, at - SIDE + 1))
                    if start < middle:
                        out.append((_key(anchor, b"<", raw[at - SIDE : at]), d, h, start << 32 | tag | middle - start - 1, raw[start : middle + SIZE - 1]))
                    if middle < stop:
                        out.append((_key(anchor, b">", raw[at + K : at + K + SIDE]), d, h, middle << 32 | tag | stop - middle - 1, raw[middle : stop + SIZE - 1]))
            if len(out) > 20_000:
                yield rows()
    yield rows()


#: Keeps the order of UTF-8 bytes and leaves 0 and 1 for the end and between segments, 255 for none.
_SHIFT = bytes(b + 2 if b < 0xC0 else b for b in range(256))


def repeated(segments: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
    """(segment, start) of windows that start earlier too; segments: (d, start, bytes)."""
    text = b"".join(raw.translate(_SHIFT) + b"\1" for _, _, raw in segments) + b"\0"
    where = np.zeros(len(text), np.int32)
    begin = np.cumsum([0, *(len(raw) + 1 for _, _, raw in segments)])
    for k, (_, _, raw) in enumerate(segments):
        where[begin[k] : begin[k] + len(raw) - SIZE + 1] = k + 1
    begin = begin.tolist()
    shown, least, first = None, None, []  # the window, its earliest place, and the segments that have it there
    for part in byte_order(text):
        owner = where[part]
        own = owner > 0
        for i, k in zip(part[own].tolist(), owner[own].tolist()):
            d, start, _ = segments[k - 1]
            place = (d, start + i - begin[k - 1])
            window = text[i : i + SIZE]
            if window != shown:
                shown, least, first = window, place, [k - 1]
            elif place > least:
                yield k - 1, place[1]
            elif place == least:
                first.append(k - 1)
            else:
                for other in first:
                    yield other, least[1]
                least, first = place, [k - 1]


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole keys of a shard sorted by (key, d, at), decided together until they make SHARD bytes.

    Equal segments of a key are repeats of the first of them; those of other texts at the
    first's place share its fate; what differs is sorted.
    """
    held: list[tuple[int, int, bytes]] = []
    texts: list[list[tuple[int, int]]] = []  # of each held segment: hash and packed place of every text that has it there
    out: list[tuple[int, int, int]] = []
    size, last = 0, None
    mine: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}

    def rows() -> pa.RecordBatch:
        nonlocal size
        for k, s in repeated(held) if held else ():
            out.extend((held[k][0], h, s << 32 | at & 0xFFFFF000) for h, at in texts[k])
        held.clear()
        texts.clear()
        size = 0
        found = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["d", "h", "at"])

    def close() -> None:
        nonlocal size
        if len(mine) > 1:
            for raw, (d, start, same) in mine.items():
                held.append((d, start, raw))
                texts.append(same)
                size += len(raw)
        mine.clear()

    for batch in batches:
        for key, d, h, at, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "d", "h", "at", "raw"))):
            if key != last:
                close()
                last = key
                if size > SHARD or len(out) > 100_000:
                    yield rows()
            first = mine.get(raw)
            if first is None:
                mine[raw] = (d, at >> 32, [(h, at)])
            elif (d, at >> 32) == first[:2]:
                first[2].append((h, at))
            else:
                out.append((d, h, at))
    close()
    yield rows()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            raw = (text or "").encode()
            if not found:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            at = np.sort(np.array(found, np.int64))
            start = at >> 32
            end = np.maximum.accumulate(start + (at & 63) + SIZE)
            new = np.r_[True, start[1:] > end[:-1]]
            low, high = start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
            kept, done = hashlib.sha256(), 0
            for a, b in zip(low.tolist(), high.tolist()):
                kept.update(raw[done:a])
                done = b
            kept.update(raw[done:])
            out.append((len(raw), int((high - low).sum()), len(low), kept.hexdigest()))
        n, removed, spans, sha = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SPANS else df


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    whole = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), F.xxhash64(whole).alias("h"), F.crc32(whole).bitwiseAND(_TAG).alias("tag"), "text")
    keys, tag = ["d", "h", "tag"], F.shiftright("at", 12).bitwiseAND(_TAG).alias("tag")
    sent = own.where(F.octet_length("text") >= SIZE).select(*keys, "text").mapInArrow(_anchored, "done boolean, a long, c long, d long, h long, at long")
    met = sent.repartition("a").sortWithinPartitions("done", "a", "c", "d", "at").mapInArrow(_met, "open boolean, a long, d long, h long, at long")
    met = scratch.save(met, "met")
    open_, n = met.where("open"), met.count()
    heavy = open_.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("a", F.lit(True).alias("heavy"))
    by_text = open_.join(heavy, "a", "left").groupBy("d", "h", tag)
    by_text = by_text.agg(F.collect_set(F.struct("a", "at", F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("runs"))
    texts = own.select(*keys, "text").join(_near(by_text, n), keys)
    decided = texts.mapInArrow(_texts, "key long, d long, h long, at long, raw binary").repartition("key").sortWithinPartitions("key", "d", "at").mapInArrow(_decided, "d long, h long, at long")
    decided = scratch.save(decided, "decided")
    found = met.where("not open").select("d", "h", "at").union(decided)
    more = n + decided.count()
    found = found.groupBy("d", "h", tag).agg(F.collect_set("at").alias("found"))
    rows = own.join(_near(found, more), keys, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "found")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
