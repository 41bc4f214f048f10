"""Suffix order by induced sorting with disk-backed queues.

A suffix is S-type if it is smaller than the next one, else L-type; an S-type
suffix behind an L-type one is an LMS suffix.  LMS substrings are sorted and
named, the string of names is sorted by recursion if names repeat, and the
sorted LMS suffixes induce first the L-type and then the S-type suffixes: one
queue for each first symbol holds what has been induced and comes out in
order.  Bytes are queued as arrays, names one by one.  Queues keep ``CHUNK`` numbers in memory each at most, and all beyond
``HELD`` chunks of one sorter lie in a temporary file of the task.
"""

from __future__ import annotations

import pickle
import tempfile
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from heapq import merge

import numpy as np

CHUNK, HELD, RUN = 1 << 14, 256, 1 << 20


class Store:
    """Where full chunks go: memory first, then a file."""

    def __init__(self) -> None:
        self.held, self.file = 0, None

    def put(self, chunk: array) -> array | tuple[int, int]:
        if self.held < HELD:
            self.held += 1
            return chunk
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        chunk.tofile(self.file)
        return at, len(chunk)

    def get(self, part: array | tuple[int, int]) -> array:
        if isinstance(part, array):
            return part
        self.file.seek(part[0])
        out = array("q")
        out.fromfile(self.file, part[1])
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """Numbers in order of their arrival; may grow while it is read."""

    __slots__ = ("store", "parts", "tail")

    def __init__(self, store: Store):
        self.store, self.parts, self.tail = store, [], array("q")

    def append(self, x: int) -> None:
        self.tail.append(x)
        if len(self.tail) >= CHUNK:
            self.parts.append(self.store.put(self.tail))
            self.tail = array("q")

    def __iter__(self) -> Iterator[int]:
        k, at = 0, 0
        while True:
            if k < len(self.parts):
                yield from self.store.get(self.parts[k])[at:]
                k, at = k + 1, 0
            elif at < len(self.tail):
                part, at = self.tail[at:], len(self.tail)
                full = self.tail
                yield from part
                if self.tail is not full:
                    continue
            elif k >= len(self.parts):
                return

    def __reversed__(self) -> Iterator[int]:
        yield from reversed(self.tail)
        for part in reversed(self.parts):
            yield from reversed(self.store.get(part))


def sorted_runs(items: Iterable, limit: int = RUN) -> Iterator:
    """Sorted items; runs of more than ``limit`` go through files."""
    runs, run = [], []

    def load(file) -> Iterator:
        file.seek(0)
        for _ in range(sizes[id(file)]):
            yield pickle.load(file)
        file.close()

    sizes: dict[int, int] = {}
    for x in items:
        run.append(x)
        if len(run) >= limit:
            run.sort()
            file = tempfile.TemporaryFile()
            for y in run:
                pickle.dump(y, file)
            sizes[id(file)] = len(run)
            runs.append(file)
            run = []
    run.sort()
    return merge(*map(load, runs), run) if runs else iter(run)


def suffix_order(t: Sequence[int]) -> Iterator[int]:
    """Starts of all suffixes in order; the last symbol must be smaller than all others."""
    n = len(t)
    if n < 3:
        yield from sorted(range(n), key=lambda i: t[i:])
        return
    if isinstance(t, bytes):
        for part in byte_order(t):
            yield from part.tolist()
        return
    small = bytearray(n)
    small[n - 1] = 1
    lms = array("q", [n - 1])
    for i in range(n - 2, -1, -1):
        if t[i] < t[i + 1] or t[i] == t[i + 1] and small[i + 1]:
            small[i] = 1
        elif small[i + 1]:
            if i + 1 != n - 1:
                lms.append(i + 1)
    lms.reverse()
    if len(lms) > 1 and lms[0] == n - 1:
        lms = array("q", sorted(lms))
    names, distinct = _named(t, lms)
    if distinct == len(lms):
        order = array("q", bytes(8 * len(lms)))
        for k, name in enumerate(names):
            order[name] = lms[k]
    else:
        order = array("q", (lms[k] for k in suffix_order(names)))
    yield from _induce(t, small, order)


def _named(t: Sequence[int], lms: array) -> tuple[array, int]:
    """A name for each LMS substring, in their order; a substring that continues another is the smaller."""
    text = isinstance(t, (bytes, bytearray, memoryview))
    ends = [*lms[1:], lms[-1]]

    if text and len(lms) <= RUN:
        cut = [bytes(t[i : j + 1]) + b"\xff" for i, j in zip(lms, ends)]
        names, last, name = array("q", bytes(8 * len(lms))), None, -1
        for k in sorted(range(len(cut)), key=cut.__getitem__):
            if cut[k] != last:
                last, name = cut[k], name + 1
            names[k] = name
        return names, name + 1

    def keys() -> Iterator[tuple]:
        for k, (i, j) in enumerate(zip(lms, ends)):
            yield (bytes(t[i : j + 1]) + b"\xff" if text else (*t[i : j + 1], float("inf"))), k

    names, last, name = array("q", bytes(8 * len(lms))), None, -1
    for key, k in sorted_runs(keys()):
        if key != last:
            last, name = key, name + 1
        names[k] = name
    return names, name + 1


def _induce(t: Sequence[int], small: bytearray, order: array) -> Iterator[int]:
    store = Store()
    # What cannot grow beyond the memory that queues may use needs no chunks: a list also grows while it is read.
    new = list if len(t) <= CHUNK * HELD else lambda: Queue(store)
    first, large, less = defaultdict(new), defaultdict(new), defaultdict(new)
    for i in order:
        first[t[i]].append(i)
    symbols = sorted(set(t))
    for c in symbols:
        for i in large[c] if c in large else ():
            if i:
                b = t[i - 1]
                if b >= c:
                    large[b].append(i - 1)
        for i in first[c] if c in first else ():
            if i:
                b = t[i - 1]
                if b > c:
                    large[b].append(i - 1)
    for c in reversed(symbols):
        for i in less[c] if c in less else ():
            if i:
                b = t[i - 1]
                if b < c or b == c and small[i - 1]:
                    less[b].append(i - 1)
        for i in reversed(large[c]) if c in large else ():
            if i:
                b = t[i - 1]
                if b < c:
                    less[b].append(i - 1)
    last = len(t) - 1
    yield last
    for c in symbols:
        if c in large:
            yield from large[c]
        if c in less:
            yield from reversed(less[c])
    store.close()


def byte_order(t: bytes) -> Iterator[np.ndarray]:
    """``suffix_order`` of bytes, in arrays: few symbols have long queues, which move as arrays."""
    raw = np.frombuffer(t, np.uint8)
    n = len(raw)
    if n < 3:
        yield np.array(sorted(range(n), key=lambda i: t[i:]), np.int64)
        return
    rises = np.r_[np.sign(np.diff(raw.astype(np.int16))), 1]
    at = np.where(rises != 0, np.arange(n), n)
    small = rises[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, distinct = _named(t, array("q", lms.tolist()))
    if distinct == len(lms):
        order = np.empty(len(lms), np.int64)
        order[np.frombuffer(names, np.int64)] = lms
    else:
        order = lms[np.fromiter(suffix_order(names), np.int64, len(lms))]
    yield from _induce_arrays(raw, small, order)


class Arrays:
    """Arrays of numbers in order of their arrival; beyond ``CHUNK`` * ``HELD`` numbers they lie in a file."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(256)]
        self.held, self.file = 0, None

    def put(self, symbol: int, numbers: np.ndarray) -> None:
        self.held += len(numbers)
        if self.held <= CHUNK * HELD:
            self.parts[symbol].append(numbers)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        numbers.astype(np.int64).tofile(self.file)
        self.parts[symbol].append((at, len(numbers)))

    def get(self, symbol: int, k: int) -> np.ndarray:
        part = self.parts[symbol][k]
        if isinstance(part, np.ndarray):
            return part
        self.file.seek(part[0])
        return np.fromfile(self.file, np.int64, part[1])

    def deal(self, numbers: np.ndarray, symbols: np.ndarray) -> None:
        """Each number to its symbol's queue, in order."""
        if len(numbers):
            by = np.argsort(symbols, kind="stable")
            numbers, symbols = numbers[by], symbols[by]
            edge = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(symbols)]):
                self.put(int(symbols[a]), numbers[a:b])


def _induce_arrays(raw: np.ndarray, small: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """As ``_induce``: what stands at the head of a queue is dealt on at once; what comes back to the same queue is its next part."""
    first, large, less = Arrays(), Arrays(), Arrays()
    first.deal(order, raw[order])
    symbols = np.unique(raw).tolist()
    for c in symbols:
        k = 0
        while k < len(large.parts[c]):
            i = large.get(c, k)
            i = i[i > 0] - 1
            keep = raw[i] >= c
            large.deal(i[keep], raw[i[keep]])
            k += 1
        for k in range(len(first.parts[c])):
            i = first.get(c, k)
            i = i[i > 0] - 1
            keep = raw[i] > c
            large.deal(i[keep], raw[i[keep]])
    for c in reversed(symbols):
        k = 0
        while k < len(less.parts[c]):
            i = less.get(c, k)
            i = i[i > 0] - 1
            keep = (raw[i] < c) | (raw[i] == c) & small[i]
            less.deal(i[keep], raw[i[keep]])
            k += 1
        for k in reversed(range(len(large.parts[c]))):
            i = large.get(c, k)[::-1]
            i = i[i > 0] - 1
            keep = raw[i] < c
            less.deal(i[keep], raw[i[keep]])
    yield np.array([len(raw) - 1])
    for c in symbols:
        for k in range(len(large.parts[c])):
            yield large.get(c, k)
        for k in reversed(range(len(less.parts[c]))):
            yield less.get(c, k)[::-1]
    for queues in (first, large, less):
        if queues.file is not None:
            queues.file.close()
