"""Language-model scores by a probabilistic suffix tree, beside a unigram base.

The tree's symbols are bytes: a document is its lower-cased words, each closed
by a space, and one end symbol.  Contexts have up to ``DEPTH`` bytes.  All training
documents are counted; a context is retained if it was seen ``SEEN`` times and
its next symbols diverge from those of its suffix by ``DIVERGENCE`` nats over
all its occurrences.  All retained contexts make the model, which grows with
the text; it is cut by the last two bytes of its grams into parts of ``PART``
next symbols, each built, broadcast and looked up by itself, and a task that
meets more than ``HELD`` parts loads them in turn.  Distributions are smoothed toward the longest
retained suffix by the share of different symbols (Witten-Bell), the root by
adding one.  A token's probability by the tree is that of its bytes, each from
the longest retained suffix of what precedes it.

The tree alone would price the spelling of unknown words, which the unigram
does not, so a token's probability is a mixture of the two, with a share of
``SHARE`` for the tree.

The base needs the training count of every word.  The ``FREQUENT`` commonest
are broadcast; other words meet their counts in a join on the word.

Defined cases: a null text counts as empty and has the end token only; a null
doc_id counts as the empty string when training rows are chosen; equal rows
count and score each; other columns are not read; without training rows counts
are zero and the root is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import bound_batches, words
from plumbline.runtime import Scratch

DEPTH, SEEN, DIVERGENCE, FREQUENT = 5, 16, 20.0, 1 << 18
PART, HELD = (1 << 21) - 1, 2
SHARE = 0.8
_END, _CHUNK = b"\n", 1 << 20
_SPIN = np.uint64(0x9E3779B97F4A7C15)


def mask(n: int) -> int:
    """The last n bytes of a packed gram."""
    return (1 << 8 * n) - 1


def packed(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Grams of depth + 1 bytes that end at each byte of each closed text, and where each text starts among them."""
    pad = _END * depth
    raw = np.frombuffer(b"".join(pad + t + _END for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    grams = np.zeros(len(raw), np.uint64)
    for k in range(depth + 1):
        grams[depth:] |= raw[depth - k : len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    own = np.ones(len(raw), bool)
    begin = np.cumsum(size + depth) - size - depth
    for k in range(depth):
        own[begin + k] = False
    return grams[own], np.cumsum(size) - size


def _tally_grams(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def fold() -> None:
            nonlocal keys, counts, held, waiting
            found = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            both, n = np.concatenate([keys, found[edge]]), np.concatenate([counts, np.diff(np.r_[edge, len(found)])])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            edge = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else edge
            keys, counts, held, waiting = both[edge], np.add.reduceat(n, edge) if len(edge) else n, [], 0

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(packed([closed(words(t))], depth)[0])
                waiting += len(held[-1])
                if waiting >= 8 * _CHUNK:
                    fold()
                    if len(keys) > 4 * _CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
                        keys, counts = keys[:0], counts[:0]
        fold()
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], ["key", "n"])

    return run


def _tally_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        for k in range(0, len(items), 100_000):
            part = items[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])
        seen.clear()

    for batch in batches:
        for t in batch.column(0).to_pylist():
            seen.update(words(t))
        if len(seen) > 1_000_000:
            yield from rows()
    yield from rows()


class Table:
    """Packed keys to numbers, as arrays with open addressing; key 0 is not used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        left, slot = np.arange(len(keys)), (keys * _SPIN) >> self.shift
        while len(left):
            free = self.keys[slot] == 0
            first = np.unique(slot[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            stay = np.ones(len(left), bool)
            stay[take] = False
            left, slot = left[stay], (slot[stay] + np.uint64(1)) & self.wrap

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        slot = (keys * _SPIN) >> self.shift
        got = self.keys[slot]
        hit = got == keys
        open_ = np.flatnonzero(~hit & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.wrap
            got = self.keys[slot[open_]]
            hit[open_] = same = got == keys[open_]
            open_ = open_[~same & (got != 0)]
        return hit, self.values[slot]


class Tree:
    """The retained contexts with their smoothed next symbols, in log10."""

    def __init__(self, depth: int, root: np.ndarray, contexts: Table, symbols: Table):
        self.depth, self.root, self.contexts, self.symbols = depth, root, contexts, symbols

    @staticmethod
    def key(grams: np.ndarray, n: int, d: int) -> np.ndarray:
        """The last n bytes at depth d; bit 63 keeps keys apart from the empty slot."""
        return grams & np.uint64(mask(n)) | np.uint64((d + 1) << 56)

    def score(self, grams: np.ndarray, depth: int | None = None) -> np.ndarray:
        """log10 of each gram's last byte, given the bytes before it."""
        out, left, tags = np.zeros(len(grams)), np.arange(len(grams)), grams
        for d in range(self.depth if depth is None else depth, 0, -1):
            hit, value = self.symbols.find(self.key(tags, d + 1, d))
            out[left[hit]] += value[hit]
            left, tags = left[~hit], tags[~hit]
            known, value = self.contexts.find(self.key(tags >> np.uint64(8), d, d))
            out[left[known]] += value[known]
        out[left] += self.root[(tags & np.uint64(255)).astype(np.int64)]
        return out

    @classmethod
    def build(cls, depth: int, root: np.ndarray, contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], symbols: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """contexts: for each d from 1 (context, its count, its different symbols); symbols: for each d (gram, count)."""
        none = np.zeros(0, np.uint64)
        tree = cls(depth, root, Table(none, np.zeros(0)), Table(none, np.zeros(0)))
        all_contexts, all_symbols, back, logs = [], [], [], []
        for d in range(1, depth + 1):
            ctx, n, kinds = contexts[d - 1]
            gram, c = symbols[d - 1]
            own = Table(cls.key(ctx, d, d), np.arange(len(ctx)))
            at = own.find(cls.key(gram >> np.uint64(8), d, d))[1]
            lower = 10.0 ** tree.score(gram, d - 1)
            logs.append(np.log10((c + kinds[at] * lower) / (n[at] + kinds[at])))
            back.append(np.log10(kinds / (n + kinds)))
            all_contexts.append(cls.key(ctx, d, d))
            all_symbols.append(cls.key(gram, d + 1, d))
            tree.contexts = Table(np.concatenate(all_contexts), np.concatenate(back))
            tree.symbols = Table(np.concatenate(all_symbols), np.concatenate(logs))
        return tree


class Forest:
    """The model in parts: cuts of the last two bytes of a gram, and the broadcast tree of each run between them."""

    def __init__(self, depth: int, cuts: list[int], parts: list[Broadcast[Tree]], held: int):
        self.depth, self.cuts, self.parts, self.held = depth, cuts, parts, held

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each gram's last byte, given the bytes before it."""
        out, last = np.zeros(len(grams)), (grams & np.uint64(0xFFFF)).astype(np.uint16)
        for part, low, high in zip(self.parts, self.cuts, self.cuts[1:]):
            own = np.flatnonzero((last >= low) & (last < high))
            for k in range(0, len(own), _CHUNK // 4):
                rows = own[k : k + _CHUNK // 4]
                out[rows] = part.value.score(grams[rows])
            if len(self.parts) > self.held:
                vars(part).pop("_value", None)  # loaded again from the executor's disk
        return out


def cuts(sizes: dict[int, int], part: int) -> list[int]:
    """Bounds of runs of last two bytes with at most ``part`` next symbols, one pair of bytes at least."""
    out, run = [0], 0
    for pair in sorted(sizes):
        if run and run + sizes[pair] > part:
            out.append(pair)
            run = 0
        run += sizes[pair]
    return [*out, 1 << 16]


def train(texts: DataFrame, scratch: Scratch, depth: int = DEPTH) -> Forest:
    """The model from all rows of a frame with one text column."""
    tallied = texts.mapInArrow(_tally_grams(depth), "key long, n long")
    levels: dict[int, DataFrame] = {}
    for d in range(depth, -1, -1):
        rows = (tallied if d == depth else levels[d + 1].select(F.col("key").bitwiseAND(mask(d + 1)).alias("key"), "n")).groupBy("key").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("ctx")  # as many rows as different next bytes, 256 at most
        rows = rows.withColumn("ctx", F.shiftright("key", 8)).withColumn("all", F.sum("n").over(own)).withColumn("kinds", F.count("*").over(own))
        levels[d] = scratch.save(rows, f"level-{d}")
    gains = None
    for d in range(1, depth + 1):
        above = levels[d - 1].select(F.col("key").alias("up"), F.col("n").alias("m"), F.col("all").alias("all_m"))
        pairs = levels[d].join(above, F.col("key").bitwiseAND(mask(d)) == F.col("up"))
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") * F.col("all_m") / F.col("m"))).alias("gain")
        level = pairs.where(F.col("all") >= SEEN).groupBy("ctx").agg(gain, F.first("all").alias("all"), F.first("kinds").alias("kinds")).where(F.col("gain") >= DIVERGENCE).withColumn("d", F.lit(d))
        gains = level if gains is None else gains.union(level)
    kept = scratch.save(gains, "contexts")
    own = [levels[d].join(kept.where(F.col("d") == d).select("ctx"), "ctx", "left_semi").select(F.lit(d).alias("d"), "key", "n", F.col("key").bitwiseAND(0xFFFF).alias("pair")) for d in range(1, depth + 1)]
    grams = scratch.save(reduce(DataFrame.union, own), "grams")
    sizes = {r["pair"]: r["count"] for r in grams.groupBy("pair").count().collect()}  # 65,536 rows at most
    root_rows = levels[0].select("key", "n").toArrow()  # 256 rows at most
    counts = np.ones(256)
    counts[root_rows["key"].to_numpy()] += root_rows["n"].to_numpy()
    bounds, parts = cuts(sizes, PART), []
    for low, high in zip(bounds, bounds[1:]):
        t = kept.where(F.col("ctx").bitwiseAND(0xFF).between(low >> 8, high - 1 >> 8)).select("d", "ctx", "all", "kinds").toArrow()
        level, *found = (t[c].to_numpy() for c in t.column_names)
        contexts = [(found[0][level == d].view(np.uint64), *(x[level == d].astype(float) for x in found[1:])) for d in range(1, depth + 1)]
        t = grams.where(F.col("pair").between(low, high - 1)).select("d", "key", "n").toArrow()  # PART rows at most
        level, *found = (t[c].to_numpy() for c in t.column_names)
        symbols = [(found[0][level == d].view(np.uint64), found[1][level == d].astype(float)) for d in range(1, depth + 1)]
        parts.append(texts.sparkSession.sparkContext.broadcast(Tree.build(depth, np.log10(counts / counts.sum()), contexts, symbols)))
    scratch.drop(*(f"level-{d}" for d in levels), "contexts", "grams")
    return Forest(depth, bounds, parts, HELD)


def closed(found: list[bytes]) -> bytes:
    """Words as the tree's bytes: each with a space behind it; the end symbol follows."""
    return b" ".join([*found, b""])


def token_scores(tree: Forest, found: list[list[bytes]]) -> np.ndarray:
    """log10 of each token by the tree: the words of each text, each with its space, and its end."""
    grams, starts = packed([closed(ws) for ws in found], tree.depth)
    sizes = np.fromiter((n for ws in found for n in (*(len(w) + 1 for w in ws), 1)), np.int64)
    return np.add.reduceat(tree.score(grams), np.cumsum(sizes) - sizes)


def mixed(base: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """log10 of the mixture of two log10 probabilities."""
    return np.log10((1 - SHARE) * 10.0**base + SHARE * 10.0**tree)


def _slices(found: list[list[bytes]], least: int) -> Iterator[list[list[bytes]]]:
    """Runs of texts with about ``least`` bytes, one text at least."""
    part, size = [], 0
    for ws in found:
        part.append(ws)
        size += sum(map(len, ws)) + len(ws) + 1
        if size >= least:
            yield part
            part, size = [], 0
    if part:
        yield part


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "suffixtree")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    texts = docs.where(~held).select("text")
    ends = texts.count()
    known = scratch.save(texts.mapInArrow(_tally_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    size = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] + ends, size["v"] + (ends > 0)
    whole = log10(n + 0.5 * (v + 1))
    top = known.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    frequent = dict(zip((w.encode() for w in top["word"].to_pylist()), top["c"].to_pylist()))
    model = spark.sparkContext.broadcast((frequent, len(frequent) < size["v"]))
    tree = train(texts, scratch)
    end = log10(ends + 0.5) - whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, more = model.value
        logs = {w: log10(c + 0.5) - whole for w, c in common.items()}
        other = np.nan if more else log10(0.5) - whole
        least = _CHUNK if len(tree.parts) <= tree.held else 4 * _CHUNK  # for a load of each part
        entry = pa.struct([("word", pa.string()), ("tree", pa.float64())])
        for batch in batches:
            given, at = batch.column("text").to_pylist(), 0
            for found in _slices([words(t) for t in given], least):
                tokens = [w for ws in found for w in (*ws, None)]
                base = np.fromiter(map(logs.get, tokens, repeat(other)), float, len(tokens))
                stop = np.cumsum([len(ws) + 1 for ws in found])
                start = np.r_[0, stop[:-1]]
                base[stop - 1] = end
                by_tree, rare = token_scores(tree, found), np.isnan(base)
                own = np.where(rare, 0.0, mixed(np.where(rare, 0.0, base), by_tree))
                lost = np.flatnonzero(rare)
                structs = pa.StructArray.from_arrays([pa.array([tokens[i] for i in lost], pa.binary()).cast(pa.string()), pa.array(by_tree[lost])], fields=list(entry))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, np.r_[start, len(tokens)]), pa.int32()), structs)
                seen = np.fromiter((sum(map(common.__contains__, ws)) for ws in found), np.int64, len(found)) + (ends > 0)
                rows = slice(at, at + len(found))
                at += len(found)
                columns = [
                    pa.array(np.add.reduceat(np.where(rare, 0.0, base), start)),
                    pa.array(seen),
                    pa.array(stop - start),
                    pa.array(np.add.reduceat(own, start)),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[rows] for c in ("row", "doc_id", "held_out")), *columns], ["row", "doc_id", "held_out", "base", "seen", "n_tokens", "score", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    rows = scratch.save(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, base double, seen long, n_tokens long, score double, rare array<struct<word:string,tree:double>>"), "scored")
    each = rows.where(F.size("rare") > 0).select("row", F.inline("rare")).join(known, "word", "left")
    plain = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - whole
    both = F.log10((1 - SHARE) * F.pow(F.lit(10.0), "plain") + SHARE * F.pow(F.lit(10.0), "tree"))
    more = each.withColumn("plain", plain).groupBy("row").agg(F.sum("plain").alias("more"), F.sum(both).alias("mixed"), F.count("c").alias("known"))
    out = rows.drop("rare").join(more, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", zero)).alias("score"),
    )
