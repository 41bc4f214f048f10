"""Questions about the workspace itself: routing of cursors, open buffers, builds, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lookup import BROADCAST_PAIRS, best_at
from plumbline.plans.closure import reverse


def route_cursors(cursors: DataFrame, snapshot: DataFrame, overlay: DataFrame, raw: DataFrame, stale: DataFrame) -> DataFrame:
    """(doc_ord, at, symbol_ord, ps, pe, source): the dirty overlay first, then the snapshot unless its document is stale, then raw facts.

    overlay, snapshot and raw are occurrences; stale: (doc_ord).
    """
    fresh = snapshot.join(stale.select("doc_ord").distinct(), "doc_ord", "left_anti")
    parts = (("overlay", overlay), ("snapshot", fresh), ("raw", raw))
    # All three are asked at once: the first source that holds the cursor, in it the smallest span.
    spans = None
    for rank, (_, occ) in enumerate(parts):
        part = occ.select("seq", "doc_ord", "symbol_ord", "ps", "pe", F.lit(rank).alias("rank"))
        spans = part if spans is None else spans.union(part)
    name = F.coalesce(*(F.when(F.col("x.rank") == rank, name) for rank, (name, _) in enumerate(parts)), F.lit("NoSymbolAtCursor"))
    return best_at(spans, cursors, "rank").select("doc_ord", "at", "x.symbol_ord", "x.ps", "x.pe", name.alias("source"))


def dirty(buffers: DataFrame, disk: DataFrame) -> DataFrame:
    """(uri, dirty) of open buffers (uri, text): the text differs from the file's, or there is no file. Works for a stream of buffers too."""
    rows = buffers.join(disk.select("uri", F.col("text").alias("saved")), "uri", "left")
    return rows.select("uri", (~F.col("text").eqNullSafe(F.col("saved"))).alias("dirty"))


def compile_domain(saves: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """(seq, target_ord): what a saved document makes stale, which is its target and all that use it. Works for a stream of saves too."""
    users = reverse(closure)
    own = saves.join(docs.select("uri", F.col("target_ord").alias("source")), "uri")
    return own.join(users, "source").select("seq", F.col("reached").alias("target_ord"))


def spec_of(docs: DataFrame) -> DataFrame:
    """(uri, target_ord, copies): the first target of each document, and how many have it."""
    return docs.groupBy("uri").agg(F.min("target_ord").alias("target_ord"), F.count("*").alias("copies"))


def requesting_target(uris: DataFrame, docs: DataFrame, roots: DataFrame) -> DataFrame:
    """(uri, target_ord): the document's own target, else that of the deepest root (root, target_ord) that contains it."""
    # Few roots hold all documents, so a root is a hot key: small tables of roots are broadcast.
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_PAIRS else roots
    parts = F.split("uri", "/")
    ways = uris.select("uri", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("root")))).alias("w"))
    deep = ways.join(roots, F.col("w.root") == roots["root"]).groupBy("uri").agg(F.max_by("target_ord", "w.depth").alias("by_root"))
    own = docs.groupBy("uri").agg(F.min("target_ord").alias("own"))
    return uris.distinct().join(own, "uri", "left").join(deep, "uri", "left").select("uri", F.coalesce("own", "by_root").alias("target_ord"))


def closures_seen(asked: DataFrame, closure: DataFrame) -> DataFrame:
    """(uri, n, reached) of (uri, target_ord): the targets in the closure (source, reached) of each document's target, in order.

    What a target reaches is gathered once for the target and not for each of
    its documents, of which one target can have most.
    """
    lists = closure.groupBy(F.col("source").alias("target_ord")).agg(F.array_sort(F.collect_list("reached")).alias("reached"))
    lists = F.broadcast(lists) if closure.count() <= BROADCAST_PAIRS else lists
    return asked.join(lists, "target_ord").select("uri", F.size("reached").cast("long").alias("n"), "reached")


def doctor(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """(bsp_id, report): one JSON report for each target: documents, stale ones, and whether it can be indexed."""
    per = docs.groupBy("target_ord").agg(F.count("*").alias("documents"), F.count_if(F.col("state") == "Stale").alias("stale"), F.count_if(F.col("state") == "MissingMd5").alias("unknown"))
    rows = targets.join(per, "target_ord", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    body = F.struct(zero("documents").alias("documents"), zero("stale").alias("stale"), zero("unknown").alias("unknown"), F.when(zero("documents") == 0, "empty").when(zero("stale") > 0, "stale").otherwise("fresh").alias("status"))
    return rows.select("bsp_id", F.to_json(body).alias("report"))
