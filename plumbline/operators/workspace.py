"""The workspace around an index: open buffers, raw facts of stale documents, searchable symbols, watched files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import symbols as grammar
from plumbline.functions import uris
from plumbline.functions.masks import freshness

# Kind codes that a search shows: class, trait, interface, object, package object, method, macro, type, field.
SEARCHABLE = (13, 14, 18, 10, 20, 3, 6, 7, 19)
# What a method answers before the workspace is ready.
NOT_READY = ("references", "rename")
EMPTY = "documentHighlight workspaceSymbol documentSymbol implementation incomingCalls outgoingCalls completion definition typeDefinition inlayHint codeAction foldingRange formatting".split()
NULL = "hover signatureHelp prepareRename prepareCallHierarchy selectionRange semanticTokensFull semanticTokensFullDelta semanticTokensRange".split()
# Watched files, the configuration by a name of its own, and what their change leads to.
WATCHED = {"facts": r"\.semanticdb$", "config": r"(^|/)\.workspace/config\.json$", "connection": r"(^|/)\.bsp/[^/]*\.json$"}
ACTIONS = {"facts": "reindex scheduled", "config": "pc config re-read", "connection": "bsp change logged"}
_PART = r"[\p{IsAlphabetic}\p{N}_$]"


def identifier_span(content: Column, char: Column) -> Column:
    """(start, end) in UTF-16 columns of the identifier that touches a column of a line; null where there is none."""
    units = F.regexp_replace(content, r"[\x{10000}-\x{10FFFF}]", "￿￿")  # two units that are no part of an identifier
    at = F.least(char, F.length(units))
    left = F.length(F.regexp_extract(F.reverse(F.substring(units, F.lit(1), at)), f"^{_PART}*", 0))
    right = F.length(F.regexp_extract(F.substring(units, at + 1, F.length(units)), f"^{_PART}*", 0))
    return F.when(left + right > 0, F.struct((at - left).alias("start"), (at + right).alias("end")))


def overlay_at(cursors: DataFrame, buffers: DataFrame, dirty: DataFrame) -> DataFrame:
    """(uri, line, char, start, end): the token under each cursor in dirty buffers (uri, text); other buffers and lines give no row."""
    lines = buffers.join(dirty.where("dirty").select("uri"), "uri", "left_semi").select("uri", F.posexplode(F.split("text", "\r?\n")).alias("line", "content"))
    met = cursors.join(lines, ["uri", "line"]).withColumn("x", identifier_span(F.col("content"), F.col("char")))
    return met.where("x is not null").select("uri", "line", "char", "x.start", "x.end")


def raw_fallback(asked: DataFrame, raw: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """(uri, symbol, ps, pe, is_def, status) for asked (uri, symbol): the symbol's occurrences in the raw facts of its own document, if these are those of the text.

    raw: (uri, md5, symbol, ps, pe, is_def); texts: (uri, text); sources:
    (uri) of all targets.  A document without facts is NoSemanticdb if a target
    has it, else NotIndexed; one whose facts do not fit its text is StaleIndex.
    A fresh document without the symbol gives one row without a place.
    """
    docs = raw.groupBy("uri").agg(F.first("md5").alias("md5")).join(texts, "uri", "left")
    fresh = F.coalesce(freshness(F.col("text"), F.col("md5")) == "Fresh", F.lit(False))
    state = docs.select("uri", F.when(fresh, "ok").otherwise("StaleIndex").alias("status"))
    owned = sources.select("uri").distinct().withColumn("owned", F.lit(True))
    rows = asked.join(state, "uri", "left").join(owned, "uri", "left")
    rows = rows.select("uri", "symbol", F.coalesce("status", F.when(F.col("owned"), "NoSemanticdb").otherwise("NotIndexed")).alias("status"))
    hits = raw.select("uri", "symbol", "ps", "pe", "is_def", F.lit("ok").alias("status"))
    return rows.join(hits, ["uri", "symbol", "status"], "left").select("uri", "symbol", "ps", "pe", "is_def", "status")


def active(uris_asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(uri, active): is the document in the current generation?"""
    known = docs.select("uri").distinct().withColumn("k", F.lit(True))
    return uris_asked.select("uri").distinct().join(known, "uri", "left").select("uri", F.coalesce("k", F.lit(False)).alias("active"))


def searchable(infos: DataFrame, defined: DataFrame) -> DataFrame:
    """The symbol infos (symbol, kind, …) that a search shows: global, of a searchable kind, and defined."""
    return infos.where(F.col("kind").isin(*SEARCHABLE) & grammar.is_global(F.col("symbol"))).join(defined.select("symbol").distinct(), "symbol", "left_semi")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by the order; sorted by it, this is each value where it first appears."""
    return rows.withColumn("#n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("`#n` = 1").drop("#n")


def below_roots(files: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """(uri, path) for file uris: the path below a root, of the deepest root whose path is known, else of the deepest; no row outside all roots.

    roots: (root) as absolute paths; known: (path) of documents.
    """
    paths = files.select("uri", uris.normalize_path(uris.uri_to_path(F.col("uri"))).alias("file")).where("file is not null").distinct()
    parts = F.split("file", "/")
    # Every folder above the file is a candidate: equal keys, as many as the path is deep.
    ways = paths.select("uri", "file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("root")))).alias("w"))
    clean = roots.select(uris.normalize_path(F.col("root")).alias("root")).select(F.when(F.col("root") == "/", "").otherwise(F.col("root")).alias("root")).distinct()
    met = ways.select("uri", "file", "w.depth", "w.root").join(clean, "root").withColumn("path", F.substring("file", F.length("root") + 2, F.length("file")))
    met = met.join(known.select("path").distinct().withColumn("k", F.lit(True)), "path", "left")
    return met.groupBy("uri").agg(F.max_by("path", F.struct(F.col("k").isNotNull(), "depth")).alias("path"))


def watched(events: DataFrame) -> DataFrame:
    """(batch, facts, config, connection, unmatched, actions) of file events (batch, path); works for a stream with ``foreachBatch`` too."""
    kinds = {k: F.rlike("path", F.lit(p)) for k, p in WATCHED.items()}
    none = ~(kinds["facts"] | kinds["config"] | kinds["connection"]) | F.col("path").isNull()
    counts = events.groupBy("batch").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()), F.count_if(none).alias("unmatched"))
    done = F.array_join(F.filter(F.array(*(F.when(F.col(k) > 0, a) for k, a in ACTIONS.items())), lambda a: a.isNotNull()), ", ")
    return counts.withColumn("actions", F.when(done == "", "no action").otherwise(done))


def before_ready(method: Column) -> Column:
    """error, empty or null: what a request gets while the workspace starts; null for unknown methods."""
    return F.when(method.isin(*NOT_READY), "error").when(method.isin(*EMPTY), "empty").when(method.isin(*NULL), "null")


def result_counters(requests: DataFrame) -> DataFrame:
    """(uri, seq, result_id): requests (uri, seq, kind) of a document number its results; a close starts anew."""
    order = Window.partitionBy("uri").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = requests.withColumn("life", F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(order)).where("kind <> 'close'")
    return rows.select("uri", "seq", F.row_number().over(Window.partitionBy("uri", "life").orderBy("seq")).alias("result_id"))
