"""Ranked search for frames of queries, over projections L and D."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions import symbols as grammar
from plumbline.operators import references, search_index
from plumbline.plans import projections as p
from plumbline.plans.queries import L, query

#: Symbols of a part, a few dozen MB.
SYMBOLS = 100_000


def _index(l: L) -> search_index.Index:
    return search_index.build(l.symbols.select("symbol_ord", "display", F.col("p_brand").alias("owner"), F.lit("mfr").alias("package_name")))


# Names are lower-case words with one space between; the patterns place a query's characters in the words and on their starts.
p.SQL["scored"] = r"""
    qs as (select q query, list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda t: t <> '') parts, regexp_replace(lower(q), '[^a-z0-9]', '', 'g') n from ask),
    field as (select symbol_ord, unnest(list_filter(string_split_regex(lower(display || ' ' || p_brand || ' mfr'), '[^a-z0-9]+'), lambda t: t <> '')) tok from sym),
    word_ as (select tok, list(distinct symbol_ord) syms from field group by tok),
    qt as (select query, len(list_distinct(parts)) k, unnest(list_distinct(parts)) t from qs),
    lead_ as (select query, k, t, unnest(syms) symbol_ord from qt join word_ on starts_with(tok, t)),
    sure as (select query, symbol_ord from lead_ group by query, symbol_ord having count(distinct t) = any_value(k)),
    keys as (select symbol_ord, 0 l, replace(display, ' ', '') as key from sym union all select symbol_ord, 1, array_to_string(list_transform(string_split(display, ' '), lambda x: left(x, 1)), '') from sym),
    least_ as (select left(key, 1) f, symbol_ord, min((l, key)) k from keys group by 1, 2),
    firsts as (select f, symbol_ord from least_ qualify row_number() over (partition by f order by k, symbol_ord) <= 5000),
    near as (select query, symbol_ord from qs join firsts on len(parts) = 1 and f = left(parts[1], 1)),
    pair as (select query, symbol_ord, bool_or(s) sure from (select *, true s from sure union all select *, false from near) group by all),
    shape as (select pair.*, qs.n, sym.display, replace(sym.display, ' ', '') m, length(replace(sym.display, ' ', ''))::int len from pair join qs using (query) join sym using (symbol_ord)),
    pat as (select *, regexp_matches(m, array_to_string(string_split(n, ''), '.*')) sub,
      list_bool_or(list_transform(range(1, length(n)), lambda k: regexp_matches(display, '^' || array_to_string(string_split(n[:k], ''), '[^ ]*') || '.* ' || array_to_string(string_split(n[k + 1:], ''), '.*')))) two,
      regexp_matches(display, '^' || array_to_string(string_split(n, ''), '.*')) or list_bool_or(list_transform(range(0, length(n)), lambda k: regexp_matches(display, case when k = 0 then '' else array_to_string(string_split(n[:k], ''), '[^ ]*') || '[^ ]*' end || ' ' || array_to_string(string_split(n[k + 1:], ''), '.*')))) one
      from shape),
    scored as (select query, symbol_ord, display, sure, case when m = n then 1000000 - len when starts_with(m, n) then 100000 - len when sub then 1000 + 1000 * (case when two then 2 when one then 1 else 0 end) - len end::int score from pat)"""
_RANKED = "select query, rank, symbol_ord, display, score from (select *, (row_number() over (partition by query order by score desc nulls last, symbol_ord))::int rank from scored where sure or score is not null) where rank <= {}"


def _search(ask: str, limit: int) -> tuple[str, str]:
    p.SQL[f"ask{limit}"] = f"ask as ({ask})"
    return f"sym ask{limit} scored", _RANKED.format(limit)


@query(*_search("select distinct display q from sym", 200))
def search_batch(spark, sf_dir):
    """Every part name as a query."""
    l = L(spark, sf_dir)
    return search_index.search_batch(_index(l), l.symbols.select(F.col("display").alias("query")))


@query(*_search("select distinct left(w, 2) q from (select unnest(string_split(display, ' ')) w from sym) union select distinct left(w, 1) from (select unnest(string_split(display, ' ')) w from sym)", 25))
def search_fuzzy_batch(spark, sf_dir):
    """The first one and two letters of every word as queries: prefixes, initials and subsequences."""
    l = L(spark, sf_dir)
    words = l.symbols.select(F.explode(F.split("display", " ")).alias("w"))
    asked = words.select(F.explode(F.array(F.substring("w", 1, 2), F.substring("w", 1, 1))).alias("query"))
    return search_index.search_batch(_index(l), asked, 25)


@query(*_search("select distinct w || ' ' || lower(left(p_brand, 2)) q from (select unnest(string_split(display, ' ')) w, p_brand from sym)", 30))
def search_fields_batch(spark, sf_dir):
    """A word and the start of a brand: tokens of several fields, one of them everywhere."""
    l = L(spark, sf_dir)
    words = l.symbols.select(F.explode(F.split("display", " ")).alias("w"), F.lower(F.substring("p_brand", 1, 2)).alias("b"))
    return search_index.search_batch(_index(l), words.select(F.concat_ws(" ", "w", "b").alias("query")), 30)


@query("sym", "select distinct q, t.symbol_ord from (select distinct left(w, 1 + symbol_ord % 5) q from (select symbol_ord, unnest(string_split(display, ' ')) w from sym)) q join (select symbol_ord, unnest(string_split(lower(display || ' ' || replace(p_brand, '#', ' ') || ' mfr'), ' ')) tok from sym) t on starts_with(t.tok, q.q)")
def prefix_join(spark, sf_dir):
    """Query tokens to field tokens by prefix, on the longest bucket that each query fills."""
    l = L(spark, sf_dir)
    words = l.symbols.select("symbol_ord", F.explode(F.split("display", " ")).alias("w"))
    asked = words.select(F.substring(F.col("w"), F.lit(1), 1 + F.col("symbol_ord") % 5).alias("q"))
    tokens = F.concat(*(names.field_tokens(c) for c in (F.coalesce("display", F.lit("")), F.coalesce("p_brand", F.lit("")), F.lit("mfr"))))
    known = p.dealt(l.symbols.select("symbol_ord", tokens.alias("tokens")), "symbol_ord", SYMBOLS)
    return search_index.prefix_join(asked, known.groupBy("symbol_ord").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")))


_MEMBERS = ", q as (select distinct upper(left(display, 1)) || substr(display, 2, 1) || upper(left(string_split(display, ' ')[-1], 1)) query from sym), nm as (select symbol_ord, array_to_string(list_transform(string_split(display, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') nm from sym)"


@query("sym", _MEMBERS + " select query, symbol_ord from q join nm on regexp_matches(nm, left(query, 2) || '.*' || right(query, 1))")
def member_batch(spark, sf_dir):
    """Initials of every name, with the second letter, as member queries over all names."""
    l = L(spark, sf_dir)
    first = lambda c: F.upper(F.substring(c, 1, 1))
    asked = l.symbols.select(F.concat(first(F.col("display")), F.substring("display", 2, 1), first(F.element_at(F.split("display", " "), -1))).alias("query"))
    return search_index.member_batch(l.symbols.select("symbol_ord", F.initcap("display").alias("name")), asked)


@query("sym", r"""
, s as (select symbol_ord, upper(left(display, 1)) || substr(split_part(display, ' ', 1), 2) || ' ' || upper(left(split_part(display, ' ', 2), 1)) || substr(split_part(display, ' ', 2), 2) as name from sym)
select symbol_ord, regexp_matches(name, 'Bl') matched from s""")
def fuzzy_match(spark, sf_dir):
    """Member search: an upper-case character may skip ahead, a lower-case one must follow it."""
    pattern = search_index.member_pattern(F.lit("Bl"))
    return L(spark, sf_dir).symbols.select("symbol_ord", F.rlike(F.initcap("display"), pattern).alias("matched"))


@query("sym posting", "select p.symbol_ord, uri, ps, pe from sym join posting p using (symbol_ord) where is_def and starts_with(display, 'blue')")
def search_methods(spark, sf_dir):
    l = L(spark, sf_dir)
    hits = search_index.member_batch(l.symbols.select("symbol_ord", F.col("display").alias("name")), spark.createDataFrame([("blue",)], "query string"))
    return l.postings.where("is_def").join(hits, "symbol_ord", "left_semi").select("symbol_ord", "uri", "ps", "pe")


@query("posting closure sym", """
, spot as (select d.symbol_ord, d.doc_ord, d.ps, d.pe, arg_min(o.symbol_ord, (o.pe - o.ps, o.ps, o.seq)) found from def d join occ o on o.doc_ord = d.doc_ord and d.ps between o.ps and o.pe group by 1, 2, 3, 4),
q as (select target_ord target, 'p' || target_ord % 10 query from target),
s as (select q.target, query, semantic_symbol symbol, dd.uri, spot.ps, spot.pe from spot join sym using (symbol_ord) join doc dd on dd.doc_ord = spot.doc_ord join closure k on k.reached = dd.target_ord join q on q.target = k.source where found = symbol_ord and regexp_matches(split_part(semantic_symbol, '#', 2), '^p[0-9]*' || right(query, 1)))
select *, row_number() over (partition by target, query order by symbol, uri, ps, pe)::int rank from s""")
def method_hits(spark, sf_dir):
    """A query of each target: methods that match it, defined where the target can see them, in order."""
    l = L(spark, sf_dir)
    last = grammar.split_last(F.col("semantic_symbol"))
    methods = l.symbols.where(last["kind"] == "method").select("symbol_ord", F.col("semantic_symbol").alias("symbol"), last["name"].alias("name"))
    asked = l.targets.select(F.col("target_ord").alias("target"), F.concat(F.lit("p"), (F.col("target_ord") % 10).cast("string")).alias("query"))
    own = l.groups.select("symbol_ord", F.col("symbol_ord").alias("component"))
    found = references.exact_definitions(own, l.defs, l.occ, l.docs, l.closure).drop("rank").withColumnRenamed("from_target", "target")
    return search_index.method_hits(methods, asked, found)
