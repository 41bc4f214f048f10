"""Call hierarchy and outlines over entries (doc, start, symbol, owners).

owners: the symbols around the entry from the outermost, itself last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing(entries: DataFrame, references: DataFrame) -> DataFrame:
    """Each reference (doc, at, …) with the last entry that starts at or before it: a backward as-of join.

    Both sides become one sorted stream of the document; entries are carried
    forward, so no pair of rows is ever made.
    """
    more = [c for c in references.columns if c not in ("doc", "at")]
    left = entries.select("doc", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("start", "symbol").alias("e"), *(F.lit(None).cast(references.schema[c].dataType).alias(c) for c in more))
    right = references.select("doc", "at", F.lit(1).alias("side"), F.lit(None).cast(left.schema["e"].dataType).alias("e"), *more)
    order = Window.partitionBy("doc").orderBy("at", "side", F.col("e.symbol")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(right).withColumn("in", F.last("e", ignorenulls=True).over(order)).where("side = 1")
    return rows.select("doc", "at", *more, F.col("in.symbol").alias("enclosing"), F.col("in.start").alias("enclosing_start"))


def enclosing_in(rows: DataFrame) -> DataFrame:
    """The same where entries and references are rows of one stream (doc, at, entry, …): entry is the symbol that starts there, null elsewhere; every row with its entry.

    Rows that are dealt by document stay where they are.
    """
    order = Window.partitionBy("doc").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("entry").isNotNull(), F.struct(F.col("at").alias("start"), F.col("entry").alias("symbol")))).over(order)
    more = [c for c in rows.columns if c not in ("doc", "at", "entry")]
    return rows.withColumn("in", last).select("doc", "at", *more, F.col("in.symbol").alias("enclosing"), F.col("in.start").alias("enclosing_start"))


def successors(entries: DataFrame) -> DataFrame:
    """Each entry with the start of the first later entry that does not lie inside it: (doc, symbol, start, next)."""
    order = Window.partitionBy("doc").orderBy("start", "symbol")
    rows = entries.withColumn("pos", F.row_number().over(order))
    # What lies inside an entry follows it without a gap until the successor: runs of positions for each owner.
    links = rows.select("doc", "symbol", "pos", F.explode(F.array_distinct("owners")).alias("owner"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "owner").orderBy("pos"))
    ends = links.withColumn("run", run)
    own = ends.where("owner = symbol").select("doc", "owner", "run", F.col("pos").alias("own"))
    after = own.join(ends.groupBy("doc", "owner", "run").agg((F.max("pos") + 1).alias("after")), ["doc", "owner", "run"]).select("doc", F.col("own").alias("pos"), "after")
    nexts = rows.select("doc", F.col("pos").alias("after"), F.col("start").alias("next"))
    return rows.join(after, ["doc", "pos"]).join(nexts, ["doc", "after"], "left").select("doc", "symbol", "start", "next")


def flat_successors(entries: DataFrame) -> DataFrame:
    """The same where no entry lies inside another: the next start."""
    nxt = F.lead("start").over(Window.partitionBy("doc").orderBy("start"))
    return entries.select("doc", "symbol", "start", nxt.alias("next"))


def outgoing(extents: DataFrame, references: DataFrame) -> DataFrame:
    """(doc, symbol, callee, n): references inside [start, next) of an entry, the end of the document if there is no next.

    Extents of flat entries do not overlap, so the last entry at or before a
    reference is the only one that can hold it.
    """
    inside = enclosing(extents.select("doc", "start", "symbol"), references)
    return inside.where("enclosing is not null").groupBy("doc", F.col("enclosing").alias("symbol"), "callee").agg(F.count("*").alias("n"))


def nearest_ancestor(entries: DataFrame) -> DataFrame:
    """(doc, symbol, parent, depth): the deepest owner with an entry in the same document."""
    chain = entries.select("doc", "symbol", F.posexplode("owners").alias("depth", "owner")).where("owner <> symbol")
    own = entries.select(F.col("doc").alias("d"), F.col("symbol").alias("parent")).distinct()
    best = chain.join(own, (chain["doc"] == own["d"]) & (chain["owner"] == own["parent"])).groupBy("doc", "symbol").agg(F.max_by("parent", "depth").alias("parent"), (F.max("depth") + 1).alias("depth"))
    return entries.select("doc", "symbol").distinct().join(best, ["doc", "symbol"], "left").select("doc", "symbol", "parent", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def not_imports(references: DataFrame, line: str = "content") -> DataFrame:
    """References that are not on an import line; without the line's text they stay."""
    return references.where(~F.coalesce(F.rlike(line, F.lit(r"^\s*import($|[^\w$])")), F.lit(False)))
