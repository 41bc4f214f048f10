"""Workspace symbol search over (symbol_ord, display, owner, package_name)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names, uris

CAP, LIMIT = 5000, 200


def token_table(symbols: DataFrame) -> DataFrame:
    """(token, symbol_ord) of all fields; build it once for each generation."""
    fields = [names.field_tokens(F.coalesce(c, F.lit(""))) for c in ("display", "owner", "package_name")]
    return symbols.select("symbol_ord", F.explode(F.array_distinct(F.concat(*fields))).alias("token"))


def prefix_and(tokens: DataFrame, query: str) -> DataFrame:
    """Symbols that have, for every token of the query, a token with that prefix."""
    wanted = sorted({t.lower() for t in re.findall(r"[^\W_]+", query)})
    if not wanted:
        return tokens.select("symbol_ord").limit(0)
    hit: Column = F.lit(False)
    for t in wanted:
        hit |= F.startswith("token", F.lit(t))
    asked = F.explode(F.filter(F.array(*(F.when(F.startswith("token", F.lit(t)), t) for t in wanted)), lambda x: x.isNotNull()))
    found = tokens.where(hit).select("symbol_ord", asked.alias("t"))
    return found.groupBy("symbol_ord").agg(F.count_distinct("t").alias("n")).where(F.col("n") == len(wanted)).select("symbol_ord")


def fuzzy_candidates(symbols: DataFrame, first: str, cap: int = CAP) -> DataFrame:
    """Up to ``cap`` symbols whose normalised name, then whose initials start with a character, in key order; each counts once."""
    keyed = symbols.select("symbol_ord", F.explode(F.array(F.struct(F.lit(0).alias("list"), names.normalize(F.col("display")).alias("key")), F.struct(F.lit(1).alias("list"), names.initials(F.col("display")).alias("key")))).alias("k"))
    firsts = keyed.where(F.startswith("k.key", F.lit(first))).groupBy("symbol_ord").agg(F.min("k").alias("k"))
    return firsts.orderBy("k.list", "k.key", "symbol_ord").limit(cap).select("symbol_ord")


def search(symbols: DataFrame, query: str, limit: int = LIMIT, tokens: DataFrame | None = None) -> DataFrame:
    """(symbol_ord, display, score), best first: scored names by score, then matches by owner or package alone."""
    wanted = re.findall(r"[^\W_]+", query)
    found = prefix_and(token_table(symbols) if tokens is None else tokens, query)
    rows = symbols.join(found, "symbol_ord", "left_semi").select("symbol_ord", "display", names.score(query, F.col("display")).alias("score"))
    if len(wanted) == 1:
        near = fuzzy_candidates(symbols, wanted[0][0].lower())
        more = symbols.join(near, "symbol_ord", "left_semi").join(found, "symbol_ord", "left_anti")
        rows = rows.union(more.select("symbol_ord", "display", names.score(query, F.col("display")).alias("score")).where("score is not null"))
    return rows.orderBy(F.desc_nulls_last("score"), "symbol_ord").limit(limit)


def resolved(hits: DataFrame, symbols: DataFrame, defs: DataFrame, docs: DataFrame, roots: DataFrame) -> DataFrame:
    """(rank, symbol_ord, display, container, uri, ps, pe): ranked hits (symbol_ord, display, score) as locations.

    Hits without a known document or target drop out; the container is the
    owner, else the package, else null; uris are absolute, below the target's
    root (target_ord, root).
    """
    order = Window.orderBy(F.desc_nulls_last("score"), "symbol_ord")  # no more rows than the search's limit
    ranked = hits.withColumn("rank", F.row_number().over(order))
    own = symbols.select("symbol_ord", F.coalesce(F.nullif("owner", F.lit("")), F.nullif("package_name", F.lit(""))).alias("container"))
    site = defs.join(docs.select(F.col("doc_ord").alias("def_doc"), F.col("uri").alias("path"), "target_ord"), "def_doc").join(roots, "target_ord")
    uri = uris.path_to_uri(uris.normalize_path(F.concat_ws("/", "root", "path")))
    found = ranked.join(own, "symbol_ord").join(site, "symbol_ord")
    return found.select("rank", "symbol_ord", "display", "container", uri.alias("uri"), F.col("def_ps").alias("ps"), F.col("def_pe").alias("pe"))


def then(first: DataFrame, second: DataFrame) -> DataFrame:
    """(display, origin, rank): the rows (display, k) of the index in their order, then those of open buffers in theirs."""
    rows = first.select("display", F.lit("index").alias("origin"), F.lit(0).alias("part"), "k").union(second.select("display", F.lit("unsaved"), F.lit(1), "k"))
    return rows.select("display", "origin", F.row_number().over(Window.orderBy("part", "k")).alias("rank"))  # limited lists
