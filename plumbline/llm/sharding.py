"""Shards of near-equal size by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts are
neighbours.  A sample drawn with a chance in proportion to size gives splitters
at its quantiles; they cut the order into many ranges.  Where the sample shows
one text at several quantiles, that overfull range is subdivided by doc_id;
every other splitter lies between texts.  The exact bytes of each range are
then summed, and running sums inside the ranges give each record its exact
place in the whole order, from which the shard follows: the sample decides how
the work is dealt, not the outcome.

The law is ``bytes``: shard k takes what lies in the k-th part of all bytes.
Equal texts share a shard unless together they exceed ``WHOLE`` of a shard;
such a group may be cut where a shard ends.  Shards thus differ by at most one
record or one small group at either end.

Defined cases: a null text has size 1 and the checksum of an empty text; a null
doc_id sorts first; equal rows get neighbouring slots; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import Scratch

SHARDS, RANGES, MOST_RANGES, ROWS_A_RANGE, DRAWS, WHOLE = 16, 256, 1 << 16, 4_000_000, 32, 0.01
_LEAST = -(1 << 63)


def splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """At the quantiles of a sorted sample of (hash, id, weight); an id only where one hash is at several quantiles."""
    total, run, found = sum(w for _, _, w in sample), 0.0, []
    for h, d, w in sample:
        run += w
        if run * ranges >= (len(found) + 1) * total and len(found) < ranges - 1:
            while run * ranges >= (len(found) + 1) * total and len(found) < ranges - 1:
                found.append((h, d))
    found = sorted(set(found))
    return [(h, d if sum(1 for g, _ in found[max(0, i - 1) : i + 2] if g == h) > 1 else _LEAST) for i, (h, d) in enumerate(found)]


def _range_of(rows: DataFrame, cuts: list[tuple[int, int]], bits: int) -> DataFrame:
    """Adds ``range``: how many cuts lie at or before (h, d). The table of cuts has one row for each prefix of h, 4 * MOST_RANGES at most."""
    table, hashes = [], [h for h, _ in cuts]
    for prefix in range(-(1 << bits - 1), 1 << bits - 1):
        low, high = bisect_left(hashes, prefix << 64 - bits), bisect_left(hashes, prefix + 1 << 64 - bits)
        table.append({"prefix": prefix, "base": low, "cuts": [{"h": h, "d": d} for h, d in cuts[low:high]]})
    schema = "array<struct<prefix:long,base:long,cuts:array<struct<h:long,d:long>>>>"
    lookup = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), schema)))
    before = F.filter("cuts", lambda c: (c.h < F.col("h")) | (c.h == F.col("h")) & (c.d <= F.col("d")))
    return rows.withColumn("prefix", F.shiftright("h", 64 - bits)).join(F.broadcast(lookup), "prefix").withColumn("range", F.col("base") + F.size(before)).drop("prefix", "base", "cuts")


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    text: Column = F.coalesce("text", F.lit(""))
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = scratch.save(rows.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))), "rows")
    all_rows = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, n = all_rows["size"] or 0, all_rows["n"]
    ranges = ranges or min(MOST_RANGES, max(RANGES, n // ROWS_A_RANGE))
    rate = DRAWS * ranges / max(total, 1)
    drawn = rows.where(F.rand(11) < F.col("size") * rate).select("h", "d", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("w"))
    cuts = splitters(sorted((r["h"], r["d"], r["w"]) for r in drawn.collect()), ranges)  # DRAWS * ranges rows are expected
    rows = scratch.save(_range_of(rows, cuts, (4 * ranges - 1).bit_length()), "ranged")
    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"))
    inside = Window.partitionBy("range").orderBy("h", "d", "size")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("range", "h")
    placed = (
        rows.withColumn("at", F.sum("size").over(up_to) - F.col("size"))
        .withColumn("row", F.row_number().over(inside))
        .withColumn("group_at", F.min("at").over(alike))
        .withColumn("group_size", F.sum("size").over(alike))
        .join(F.broadcast(bases), "range")
    )
    small = F.col("group_size") <= int(WHOLE * total / shards)
    start, extent = F.when(small, F.col("group_at")).otherwise(F.col("at")), F.when(small, F.col("group_size")).otherwise(F.col("size"))
    middle = (2 * (F.col("byte_base") + start) + extent) * shards
    placed = placed.withColumn("shard", F.floor(middle / F.lit(max(2 * total, 1)))).withColumn("place", F.col("row_base") + F.col("row"))
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", F.least("shard", F.lit(shards - 1)).cast("int").alias("shard"), "place"), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as one folder of Parquet files for each shard; equal ids stay with their first shard."""
    where = shard(docs, shards).groupBy("doc_id").agg(F.min("shard").alias("#shard"))
    joined = docs.alias("a").join(where.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select("a.*", F.col("#shard").alias("shard"))
    joined.write.mode("overwrite").partitionBy("shard").parquet(path)
