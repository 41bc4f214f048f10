"""Selection ranges: for each cursor the spans around it, innermost first.

Spans and cursors of a document are put into one order, by place, with spans
before cursors and wider spans before narrower ones.  Tasks read that order as a
stream and keep only the spans that are open, so what a task holds is the
nesting's depth, whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "doc long, at long, chain array<struct<start:long,end:long>>"
_CHAIN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def chain_of(open_: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """The spans that hold a place, each inside the next; of spans that cross, the smaller counts; the place itself if there are none."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s for s in open_ if s[1] >= at), key=lambda s: (s[1] - s[0], s[0])):
        if not out or start <= out[-1][0] and end >= out[-1][1]:
            out.append((start, end))
    return out or [(at, at)]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, open_, crossed = None, [], False
    for batch in batches:
        docs, ats, sizes, starts, ends = [], [], [0], [], []
        for d, start, end, cursor in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "end", "cursor"))):
            if d != doc:
                doc, open_ = d, []
            while open_ and open_[-1][1] < start:
                open_.pop()
            if len(open_) < 2:
                crossed = False
            if not cursor:
                if not open_ or open_[-1] != (start, end):
                    open_.append((start, end))
                if len(open_) > 1 and end > open_[-2][1]:
                    # A span that crosses the one before hides its end: what has ended is taken out by hand.
                    open_ = [s for s in open_ if s[1] >= start]
                    crossed = True
                continue
            docs.append(d)
            ats.append(start)
            # Spans that never crossed lie inside one another already, and all of them hold the place.
            found = chain_of(open_, start) if crossed or not open_ else open_[::-1]
            for a, b in found:
                starts.append(a)
                ends.append(b)
            sizes.append(len(starts))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], fields=list(_CHAIN.value_type))
        chain = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans, type=_CHAIN)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), chain], ["doc", "at", "chain"])


def chains(spans: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc, at, chain) for the different cursors (doc, at) over spans (doc, start, end), both ends inside; spans that end before they start, and nulls, do not count."""
    own = spans.where("end >= start and doc is not null").select("doc", "start", "end", F.lit(False).alias("cursor")).distinct()
    asked = cursors.where("at is not null and doc is not null").distinct().select("doc", F.col("at").alias("start"), F.col("at").alias("end"), F.lit(True).alias("cursor"))
    rows = own.union(asked).select(F.col("doc").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), "cursor")
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return swept(rows.repartition(n, "doc"))


def swept(rows: DataFrame) -> DataFrame:
    """The same for rows (doc, start, end, cursor) that are dealt by document already: nothing is shuffled; each cursor stands once."""
    return rows.sortWithinPartitions("doc", "start", "cursor", F.desc("end")).mapInArrow(_sweep, _OUT)
