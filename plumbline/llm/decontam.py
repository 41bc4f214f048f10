"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

A passage of a document matches an item if a window with the item's number of
words has a weighted similarity of at least ``SIMILAR`` with it: over the
five-word shingles of both, lower-cased and counted, the sum of the smaller
counts over the sum of the larger.

Such a window must share at least ``need`` shingles with the item, so windows
are built only where that many shingles of items of one length lie within that
length; this loses nothing, and the rest of the corpus is never fingerprinted.
Each window gets a 64-bit SimHash of its shingles.  Different fingerprints are
looked up in the multi-index: the items' fingerprints by length and by each of
``BLOCKS`` blocks, one more than ``RADIUS``, so that every fingerprint within
the radius of an item's equals it in at least one block.  What the index gives
within the radius is then verified exactly.

Shingles that agree to 8/9, the least for a similarity of 0.8, differ in 9.7
bits on average with a deviation of 2.9; RADIUS is five deviations above that.
``tests/llm/test_decontam.py`` measures the recall against brute force.

Items shorter than five words have one shingle, the whole item.  Defined cases:
null or blank texts and items match nothing; a document of fewer words than an
item is one window; rows with equal ids count as one document, of
rows with equal item_id the smallest text; other
columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import without_texts
from plumbline.llm.text import word_array
from plumbline.runtime import Scratch

SHINGLE, SIMILAR, RADIUS, BITS = 5, 0.8, 24, 64
BLOCKS = RADIUS + 1
#: Rows of item length and shingle that are broadcast at most, 16 bytes each; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def shingles(words: str, size: int) -> Column:
    """Hashes of all shingles of a word array column, by position; none if there are fewer words."""
    last = F.size(words) - size + 1

    def one(_: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(F.col(words), i + k) for k in range(size)))

    return F.when(last > 0, F.transform(F.slice(F.col(words), 1, F.greatest(last, F.lit(1))), one))


def _block_edges() -> list[tuple[int, int]]:
    cut = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return list(zip(cut, cut[1:]))


def blocks(fp: Column) -> Column:
    """The fingerprint's blocks, in order."""
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND((1 << b - a) - 1) for a, b in _block_edges()))


def _fingerprint(weight: Column, h: Column) -> list[Column]:
    """Sums by bit, for one grouped aggregate."""
    return [F.sum(F.when(F.getbit(h, F.lit(b)) == 1, weight).otherwise(-weight)).alias(f"b{b}") for b in range(BITS)]


def _packed() -> Column:
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return fp


def _windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, g, item_id, start, n, similarity, distance)`` of every window that matches; g is the hash of its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", word_array(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    items = scratch.save(items, "items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # SHINGLE different sizes at most
    own = None
    for k in sizes:
        part = items.where(F.col("k") == k).select("item_id", "n", "k", F.explode(shingles("w", k)).alias("s"))
        own = part if own is None else own.union(part)
    if own is None:
        return spark.createDataFrame([], "doc_id long, g long, item_id long, start int, n int, similarity double, distance int")
    own = scratch.save(own.groupBy("item_id", "n", "k", "s").agg(F.count("*").alias("c")), "shingles")
    prints = own.groupBy("item_id", "n").agg(*_fingerprint(F.col("c"), F.col("s")), F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("has"))
    prints = scratch.save(prints.select("item_id", "n", _packed().alias("item_fp"), "has"), "prints")
    known = scratch.save(own.select("n", "k", "s").distinct(), "known")
    near = F.broadcast if known.count() <= BROADCAST_SHINGLES else lambda x: x

    plain = docs.select("doc_id", F.xxhash64("text").alias("g"), word_array(F.col("text")).alias("w"))
    seeds = None
    for k in sizes:
        each = plain.select("doc_id", "g", F.size("w").alias("words"), F.lit(k).alias("k"), F.posexplode(shingles("w", k)).alias("pos", "s"))
        each = each.join(near(known.where(F.col("k") == k).select("s").distinct()), "s", "left_semi")
        seeds = each if seeds is None else seeds.union(each)
    seeds = scratch.save(seeds, "seeds").dropDuplicates(["doc_id", "g", "k", "pos"])
    held = seeds.join(near(known), ["k", "s"]).select("doc_id", "g", "words", "n", "k", "pos")

    # With m shingles in the item and v in the window, I of them shared: I / (m + v - I) >= SIMILAR.
    m, v = F.col("n") - F.col("k") + 1, F.least("n", "words") - F.col("k") + 1
    need = F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (m + v) - 1e-9)
    found = held.groupBy("doc_id", "g", "n", "k", "words").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    found = found.withColumn("need", need.cast("int")).withColumn("v", v)
    dense = F.filter(F.col("at"), lambda p, i: F.get(F.col("at"), i + F.col("need") - 1) <= p + F.col("v") - 1)
    last = F.col("words") - F.least("n", "words")
    starts = F.array_distinct(F.transform(dense, lambda p: F.least(p, last)))
    windows = found.where((F.size("at") >= F.col("need")) & (F.col("v") > 0)).select("doc_id", "g", "n", "k", "v", last.alias("last"), F.explode(starts).alias("start"))
    windows = scratch.save(windows, "windows")

    where = windows.select(F.col("doc_id").alias("i"), F.col("g").alias("j")).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").join(where, F.expr("id <=> i and h = j"), "left_semi")
    texts = texts.groupBy("id", "h").agg(F.first("text").alias("text")).select("id", "h", word_array(F.col("text")).alias("w"))
    key = ["doc_id", "g", "n", "v", "last", "start"]
    content = None
    for k in sizes:
        each = windows.where(F.col("k") == k).alias("x").join(texts.alias("y"), F.expr("x.doc_id <=> y.id and x.g = y.h")).select(*key, F.slice("w", F.col("start") + 1, F.least("n", F.size("w"))).alias("w"))
        each = each.select(*key, F.posexplode(shingles("w", k)).alias("pos", "s"))
        content = each if content is None else content.union(each)
    counted = content.groupBy(*key, "s").agg(F.count("*").alias("cw"), F.min("pos").alias("pos"))
    windowed = counted.groupBy(*key).agg(*_fingerprint(F.col("cw"), F.col("s")), F.collect_list(F.struct("s", "cw")).alias("holds"), F.min_by("s", "pos").alias("opens"))
    windowed = scratch.save(windowed.select(*key, _packed().alias("fp"), "holds", "opens"), "prints-of-windows")

    candidates = lookup(windowed.select("n", "fp").distinct(), prints.select("n", "item_id", "item_fp"))
    pairs = windowed.join(candidates, ["n", "fp"]).join(prints.select("item_id", "has"), "item_id")
    shared = F.aggregate("holds", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.least(x["cw"], F.coalesce(F.try_element_at(F.col("has"), x["s"]), F.lit(0))))
    pairs = pairs.where(F.map_contains_key("has", F.col("opens")) | (F.col("start") == F.col("last"))).withColumn("shared", shared)
    total = F.col("n") - F.least("n", F.lit(SHINGLE)) + 1 + F.col("v")
    return pairs.withColumn("similarity", F.col("shared") / (total - F.col("shared"))).where(F.col("shared") * (1 + SIMILAR) >= SIMILAR * total - 1e-9).select("doc_id", "g", "item_id", "start", "n", "similarity", "distance")


def lookup(prints: DataFrame, items: DataFrame) -> DataFrame:
    """``(n, fp, item_id, distance)``: what the multi-index gives within ``RADIUS``; rows of (n, fp) and (n, item_id, item_fp)."""
    index = items.select("n", "item_id", "item_fp", F.posexplode(blocks(F.col("item_fp"))).alias("block", "value"))
    asked = prints.select("n", "fp", F.posexplode(blocks(F.col("fp"))).alias("block", "value"))
    met = asked.join(index, ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    return met.where(F.col("distance") <= RADIUS).select("n", "fp", "item_id", "distance").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity, distance)``: the best window of each document and item that match.

    start counts words from 0; it is the first of the best windows that start
    with a shared shingle or end with the text.
    """
    best = _windows(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), (-F.col("distance")).alias("d"), "n")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("long").alias("start"), F.col("x.n").cast("int").alias("n_words"), F.col("x.similarity").alias("similarity"), (-F.col("x.d")).cast("int").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, as they are; each text of a doc_id has its own verdict."""
    hit = Scratch(docs.sparkSession, "decontam").save(_windows(docs, benchmark).select("doc_id", "g").distinct(), "hit")
    return without_texts(docs, hit)
