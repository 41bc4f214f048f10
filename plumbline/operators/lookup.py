"""Lookups over occurrences: references, highlights, definitions, symbol at a position.

Every operator takes frames of cursors or symbols and answers all of them in
one plan; a single question is a frame of one row.  Frames:

occurrences (seq, doc_ord, symbol_ord, ps, pe), docs (doc_ord, uri, target_ord,
generated, readonly, dependency_source), closure (source, reached) of targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.masks import flag_word
from plumbline.plans.closure import reverse

#: Pairs of targets that are broadcast at most; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000


def definitions(occurrences: DataFrame) -> DataFrame:
    """The first occurrence of each symbol: (symbol_ord, def_doc, def_ps, def_pe, def_seq)."""
    first = F.min(F.struct("seq", F.col("doc_ord").alias("d"), F.col("ps").alias("s"), F.col("pe").alias("e"))).alias("x")
    return occurrences.groupBy("symbol_ord").agg(first).select("symbol_ord", F.col("x.d").alias("def_doc"), F.col("x.s").alias("def_ps"), F.col("x.e").alias("def_pe"), F.col("x.seq").alias("def_seq"))


def postings(occurrences: DataFrame, docs: DataFrame, defs: DataFrame) -> DataFrame:
    """Occurrences with document facts, ``is_def``, ``editable`` and the flag word."""
    rows = occurrences.join(defs.select("symbol_ord", "def_seq"), "symbol_ord").withColumn("is_def", F.col("seq") == F.col("def_seq")).drop("def_seq")
    rows = rows.join(docs, "doc_ord").withColumn("editable", ~(F.col("generated") | F.col("readonly") | F.col("dependency_source")))
    return rows.withColumn("flags", flag_word(F.col("is_def"), F.col("editable"), F.col("generated"), F.col("readonly")))


def allowed_targets(defs: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """(symbol_ord, target_ord): who can see the symbol's definition; all targets if the definition has none."""
    owner = defs.join(docs.select(F.col("doc_ord").alias("def_doc"), F.col("target_ord").alias("def_target")), "def_doc", "left").select("symbol_ord", "def_target")
    users = reverse(closure)
    known = owner.join(users, owner["def_target"] == users["source"]).select("symbol_ord", F.col("reached").alias("target_ord"))
    lost = owner.join(users.select("source").distinct(), owner["def_target"] == F.col("source"), "left_anti").select("symbol_ord")
    every = closure.select("source").distinct().agg(F.collect_list("source").alias("every"))  # one row: the targets of a build graph
    return known.union(lost.crossJoin(F.broadcast(every)).select("symbol_ord", F.explode("every").alias("target_ord")))


def seen_from(rows: DataFrame, defs: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """The rows (symbol_ord, target_ord, …) whose target can see the symbol's definition; all if the definition's target is unknown.

    Each row meets the one target of its symbol's definition, and that pair the
    closure, which has as many rows as a build graph has reachable pairs; no
    symbol is spread over the targets that see it.
    """
    owner = defs.join(docs.select(F.col("doc_ord").alias("def_doc"), F.col("target_ord").alias("def_target")), "def_doc", "left").select("symbol_ord", "def_target")
    pairs = closure.select(F.col("source").alias("target_ord"), F.col("reached").alias("def_target"), F.lit(True).alias("#sees"))
    known = closure.select(F.col("source").alias("def_target"), F.lit(True).alias("#known")).distinct()
    if closure.count() <= BROADCAST_PAIRS:
        pairs, known = F.broadcast(pairs), F.broadcast(known)
    met = rows.join(owner, "symbol_ord").join(pairs, ["target_ord", "def_target"], "left").join(known, "def_target", "left")
    return met.where("`#sees` or `#known` is null").select(*rows.columns)


def references(postings: DataFrame, defs: DataFrame, docs: DataFrame, closure: DataFrame, declarations: bool = True) -> DataFrame:
    """(symbol_ord, doc_ord, uri, ps, pe, is_def), distinct by place; a reference goes before a definition there."""
    rows = postings if declarations else postings.where(~F.col("is_def"))
    return seen_from(rows, defs, docs, closure).groupBy("symbol_ord", "doc_ord", "uri", "ps", "pe").agg(F.min("is_def").alias("is_def"))


def highlights(postings: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc_ord, symbol_ord, ps, pe, kind) in the cursor's document; cursors: (doc_ord, symbol_ord)."""
    kind = F.when(F.col("is_def"), "Write").otherwise("Read")
    return postings.join(cursors.distinct(), ["doc_ord", "symbol_ord"], "left_semi").select("doc_ord", "symbol_ord", "ps", "pe", kind.alias("kind")).distinct()


def visible_definitions(defs: DataFrame, docs: DataFrame, cursors: DataFrame, closure: DataFrame) -> DataFrame:
    """(from_target, symbol_ord, uri, ps, pe) for cursors of (from_target, symbol_ord): definitions in the target's forward closure."""
    sites = defs.join(docs.select(F.col("doc_ord").alias("def_doc"), "uri", "target_ord"), "def_doc")
    rows = cursors.distinct().join(sites, "symbol_ord")
    seen = closure.select(F.col("source").alias("from_target"), F.col("reached").alias("target_ord"))
    return rows.join(seen, ["from_target", "target_ord"], "left_semi").select("from_target", "symbol_ord", "uri", F.col("def_ps").alias("ps"), F.col("def_pe").alias("pe"))


def best_at(occurrences: DataFrame, cursors: DataFrame, *first: str) -> DataFrame:
    """(doc_ord, at, x) of each different cursor (doc_ord, at): the span that holds it, by the columns ``first``, then the smallest, the earliest start, the first record; x is null if none does.

    Spans are dealt by size: one of up to 8**k positions touches two stretches
    of that size at most, and a cursor asks one stretch of each size that
    occurs. A pair is made only where a cursor is within reach of a span, and
    as sizes go by eight, a cursor is repeated a few times only.
    """
    level = F.expr("(length(bin(pe - ps)) + 2) div 3 * 3").cast("int")
    spans = occurrences.where("pe >= ps").withColumn("level", level)
    spans = spans.withColumn("bucket", F.explode(F.array_distinct(F.array(F.expr("shiftright(ps, level)"), F.expr("shiftright(pe, level)")))))
    sizes = sorted(r[0] for r in occurrences.where("pe >= ps").select(level).distinct().collect())  # 11 at most
    asked = cursors.distinct()
    keys = asked.withColumn("level", F.explode(F.array(*(F.lit(k) for k in sizes)) if sizes else F.array().cast("array<int>")))
    keys = keys.withColumn("bucket", F.expr("shiftright(at, level)"))
    x = F.struct(*first, (F.col("pe") - F.col("ps")).alias("size"), "ps", "seq", "pe", "symbol_ord").alias("x")
    hits = keys.join(spans, ["doc_ord", "level", "bucket"]).where("ps <= at and at <= pe").select("doc_ord", "at", x)
    # Cursors without a hit come back from the same grouping, not by one more join.
    none = asked.select("doc_ord", "at", F.lit(None).cast(hits.schema["x"].dataType).alias("x"))
    return hits.union(none).groupBy("doc_ord", "at").agg(F.min("x").alias("x"))


def symbol_at(occurrences: DataFrame, cursors: DataFrame) -> DataFrame:
    """The smallest span at each cursor (doc_ord, at): then the earliest start, then the first record."""
    hits = best_at(occurrences, cursors).where("x is not null")
    return hits.select("doc_ord", "at", F.col("x.symbol_ord").alias("symbol_ord"), F.col("x.ps").alias("ps"), F.col("x.pe").alias("pe"))


def implementations(overrides: DataFrame, defs: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """(base, symbol_ord, uri, ps, pe): definitions that override the base, in targets that see its target."""
    site = docs.select(F.col("doc_ord").alias("def_doc"), "uri", "target_ord")
    own = defs.join(site, "def_doc")
    base = own.select(F.col("symbol_ord").alias("base"), F.col("target_ord").alias("base_target"))
    rows = overrides.join(own, "symbol_ord").join(base, "base")
    users = reverse(closure).select(F.col("source").alias("base_target"), F.col("reached").alias("target_ord"))
    return rows.join(users, ["base_target", "target_ord"], "left_semi").select("base", "symbol_ord", "uri", F.col("def_ps").alias("ps"), F.col("def_pe").alias("pe"))


def group_scan(postings: DataFrame, groups: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The postings with the ``component`` of their symbol, of all targets or of the allowed ones (target_ord) only."""
    rows = postings if allowed is None else postings.join(allowed.distinct(), "target_ord", "left_semi")
    return rows.join(groups, "symbol_ord")


def find_symbols(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, symbol_ord) for asked symbols (symbol): their ordinal in (semantic_symbol, symbol_ord); null where there is none."""
    return asked.join(symbols.select(F.col("semantic_symbol").alias("symbol"), "symbol_ord"), "symbol", "left").select("symbol", "symbol_ord")


def covered(uris: DataFrame, targets: DataFrame) -> DataFrame:
    """(uri, status) of (uri, target_ord): may questions about it be answered? targets: (target_ord, indexable)."""
    status = F.when(F.col("indexable").isNull(), "UnknownTarget").when(~F.col("indexable"), "NotIndexable").otherwise("ok")
    return uris.join(targets, "target_ord", "left").select("uri", status.alias("status"))
