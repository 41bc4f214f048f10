"""Ranked symbol search for frames of queries, over a written index.

The index of one generation has four tables, written once:

tokens (bucket, tokens, symbol_ord): the field tokens of a symbol, in one row for each of their
prefixes of 1, 2, 4, 8, … characters, so a query token of n characters finds
its symbols by one equality, on the longest bucket that it fills, reads at most what shares
half of its characters, and finds a symbol once;
buckets (bucket, n): how many rows a bucket has;
names (symbol_ord, display, tokens, plain, marked): what a symbol is matched and scored by;
first (first, symbol_ord): for each first character the symbols that a query of one token
considers beside its prefix matches: up to ``CAP`` by normalised name, then by initials.

A query is driven by the one of its tokens with the rarest bucket; the others are
tested on the symbols found, so a common token beside a rare one is never read.
Ranking keeps ``limit`` rows of a query in each task before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.runtime import Scratch

#: Candidates by a first character; hits of a query; parts in which a first character's candidates are ranked first.
CAP, LIMIT, PARTS = 5000, 200, 64
#: Prefix lengths of the buckets; a longer prefix than the last is compared within it.
LENGTHS = [1, 2, 4, 8, 16, 32]
#: Member queries, under 200 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_QUERIES = 100_000
#: The most hits of a query that one shuffle-free ranking in each task keeps.
DIRECT = 1000


@dataclass
class Index:
    tokens: DataFrame
    buckets: DataFrame
    names: DataFrame
    first: DataFrame


def bucket(token: Column) -> Column:
    """The longest bucket that a query token fills."""
    size = F.length(token)
    length = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        length = F.when(size >= n, n).otherwise(length)
    return F.substring(token, F.lit(1), length)


def buckets_of(token: Column) -> Column:
    """All buckets of an indexed token."""
    size = F.length(token)
    return F.filter(F.array(*(F.when(size >= n, F.substring(token, 1, n)) for n in LENGTHS)), lambda b: b.isNotNull())


def bucketed(names_: DataFrame) -> DataFrame:
    """(bucket, tokens, symbol_ord) of names (symbol_ord, tokens): a row for each bucket of a symbol, with its tokens there."""
    rows = names_.select("symbol_ord", "tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", buckets_of)))).alias("bucket"))
    return rows.select("bucket", F.filter("tokens", lambda t: F.startswith(t, F.col("bucket"))).alias("tokens"), "symbol_ord")


def starting(tokens: str, query: str) -> Column:
    """Does one of the tokens start with the query token?"""
    return F.exists(tokens, lambda t: F.startswith(t, F.col(query)))


def prefix_join(queries: DataFrame, names_: DataFrame) -> DataFrame:
    """(q, symbol_ord) of query tokens (q) and names (symbol_ord, tokens), one row for each symbol: those with a token that starts with q.

    A query token has one bucket and a symbol one row there, so each pair is found once and nothing is told apart afterwards.
    """
    asked = queries.select("q").where("q <> ''").distinct().withColumn("bucket", bucket(F.col("q")))
    asked = Scratch(queries.sparkSession, "prefix-queries").save(asked, "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_QUERIES else asked.hint("merge")
    return bucketed(names_).join(asked, "bucket").where(starting("tokens", "q")).select("q", "symbol_ord")


def best(rows: DataFrame, key: list[str], order: list[Column], k: int, part: Column) -> DataFrame:
    """The first k rows of each key with their ``rank``; each task, or each part of a key, keeps k before they meet."""
    if k > DIRECT:
        own = Window.partitionBy(*key, "#part").orderBy(*order)
        rows = rows.withColumn("#part", part).withColumn("#k", F.row_number().over(own)).where(F.col("#k") <= k).drop("#part", "#k")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def build(symbols: DataFrame, label: str = "search-index", cap: int = CAP) -> Index:
    """The index of (symbol_ord, display, owner, package_name)."""
    scratch = Scratch(symbols.sparkSession, label)
    text = lambda c: F.coalesce(c, F.lit(""))
    fields = F.array_distinct(F.concat(*(names.field_tokens(text(c)) for c in ("display", "owner", "package_name"))))
    known = symbols.select("symbol_ord", "display", fields.alias("tokens"), names.normalize(text("display")).alias("plain"), names.humps(text("display")).alias("marked"))
    known = scratch.save(known, "names")
    tokens = scratch.save(bucketed(known), "tokens")
    counts = scratch.save(tokens.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    short = F.array_join(F.transform(F.filter("marked", lambda x: x.hump), lambda x: x.c), "")
    lists = F.array(F.struct(F.lit(0).alias("list"), F.col("plain").alias("key")), F.struct(F.lit(1).alias("list"), short.alias("key")))
    keyed = known.select("symbol_ord", F.explode(lists).alias("k")).where("k.key <> ''")
    keyed = keyed.groupBy(F.substring("k.key", 1, 1).alias("first"), "symbol_ord").agg(F.min("k").alias("k"))
    order = [F.asc("k.list"), F.asc("k.key"), F.asc("symbol_ord")]
    first = best(keyed, ["first"], order, cap, F.pmod(F.xxhash64("symbol_ord"), F.lit(PARTS)))
    return Index(tokens, counts, known, scratch.save(first.select("first", "symbol_ord"), "first"))


def hump_hits(wanted: Column, marked: Column) -> Column:
    """Most characters of ``wanted`` on humps over its embeddings as a subsequence; null without one."""
    chars = F.filter(F.split(wanted, ""), lambda c: c != "")
    start = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(None).cast("int"), F.length(wanted)))

    def step(found: Column, x: Column) -> Column:
        hit = F.when(x.hump, 1).otherwise(0)
        return F.transform(found, lambda b, j: F.when((j > 0) & (x.c == F.get(chars, j - 1)), F.greatest(b, F.get(found, j - 1) + hit)).otherwise(b))

    return F.aggregate(marked, start, step, lambda found: F.get(found, F.length(wanted)))


def score(wanted: Column, plain: Column, marked: Column) -> Column:
    """Of a normalised query: exact before prefix before subsequence; shorter names first; null if it is no subsequence."""
    size = F.length(plain)
    other = F.lit(names.SUBSEQUENCE) + hump_hits(wanted, marked) * names.HUMP - size
    prefix = F.startswith(plain, wanted)
    # Characters of the query that the name lacks decide most pairs without looking for embeddings.
    return F.when((size == 0) | (F.length(wanted) == 0), None).when(plain == wanted, names.EXACT - size).when(prefix, names.PREFIX - size).when(F.length(wanted) <= size, other)


def asked(queries: DataFrame) -> DataFrame:
    """(query, wanted, parts, n_parts) of the different queries that have a token."""
    rows = queries.select("query").where("query is not null").distinct().withColumn("all", names.field_tokens(F.col("query")))
    return rows.select("query", names.normalize(F.col("query")).alias("wanted"), F.array_distinct("all").alias("parts"), F.size("all").alias("n_parts")).where("n_parts > 0")


def prefix_and(index: Index, wanted: DataFrame) -> DataFrame:
    """(query, symbol_ord): for every token of the query the symbol has a token with that prefix; wanted: rows of ``asked``."""
    each = wanted.select("query", "parts", F.explode("parts").alias("token")).withColumn("bucket", bucket(F.col("token")))
    each = each.join(index.buckets, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # The rarest token leads; one that no symbol has leads to nothing.
    lead = each.groupBy("query").agg(F.min(F.struct("n", "bucket", "token")).alias("x"), F.first("parts").alias("parts"))
    lead = lead.select("query", F.col("x.bucket").alias("bucket"), F.col("x.token").alias("lead"), F.filter("parts", lambda t: t != F.col("x.token")).alias("rest"))
    found = lead.join(index.tokens, "bucket").where(starting("tokens", "lead")).select("query", "rest", "symbol_ord")
    one, more = found.where(F.size("rest") == 0), found.where(F.size("rest") > 0)
    has = F.forall("rest", lambda q: F.exists("tokens", lambda t: F.startswith(t, q)))
    more = more.join(index.names.select("symbol_ord", "tokens"), "symbol_ord").where(has)
    return one.select("query", "symbol_ord").union(more.select("query", "symbol_ord"))


def search_batch(index: Index, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query, rank, symbol_ord, display, score) of every different query: scored names by score, then matches by owner or package alone.

    Null and empty queries, and those without a letter or digit, have no hits.
    """
    wanted = Scratch(queries.sparkSession, "search-queries").save(asked(queries), "asked")
    sure = prefix_and(index, wanted).withColumn("sure", F.lit(True))
    single = wanted.where("n_parts = 1").select("query", F.substring(F.col("parts")[0], 1, 1).alias("first"))
    near = single.join(index.first, "first").select("query", "symbol_ord", F.lit(False).alias("sure"))
    rows = sure.union(near).groupBy("query", "symbol_ord").agg(F.bool_or("sure").alias("sure"))
    rows = rows.join(wanted.select("query", "wanted"), "query").join(index.names.drop("tokens"), "symbol_ord")
    rows = rows.select("query", "symbol_ord", "display", "sure", score(F.col("wanted"), F.col("plain"), F.col("marked")).alias("score")).where("sure or score is not null")
    ranked = best(rows, ["query"], [F.desc_nulls_last("score"), F.asc("symbol_ord")], limit, F.pmod(F.xxhash64("symbol_ord"), F.lit(PARTS)))
    return ranked.select("query", "rank", "symbol_ord", "display", "score")


# Member search: case counts.


def member_pattern(query: Column) -> Column:
    """The regular expression of a member query.

    A lower-case character must follow at once; any other may skip ahead to its next
    place, and an upper-case one together with what belongs to it further still.
    """
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    chars = F.filter(F.split(query, ""), lambda c: c != "")
    is_in = lambda c, kind: F.rlike(c, F.lit(rf"^\p{{{kind}}}$"))

    def one(c: Column) -> Column:
        upper, lower = is_in(c, "IsUppercase"), is_in(c, "IsLowercase")
        return F.when(upper, F.concat(F.lit(")(?>.*?"), quote(c))).when(lower, quote(c)).otherwise(F.concat(F.lit("(?>.*?"), quote(c), F.lit(")")))

    # Groups never give back what they took: the first place that fits is as good as any later one.
    return F.concat(F.lit("(?s)^(?>"), F.array_join(F.transform(chars, one), ""), F.lit(")"))


def member_keys(name: Column) -> Column:
    """What a name is found under: the buckets of its start, and each character that is not lower-case."""
    chars = F.array_distinct(F.filter(F.split(name, ""), lambda c: (c != "") & ~F.rlike(c, F.lit(r"^\p{IsLowercase}$"))))
    return F.concat(F.transform(buckets_of(name), lambda b: F.concat(F.lit("^"), b)), F.transform(chars, lambda c: F.concat(F.lit("."), c)), F.array(F.lit("")))


def member_key(query: Column) -> Column:
    """Where a query looks: under its leading lower-case characters, else under its first character; the empty one under all."""
    start = F.regexp_extract(query, r"^\p{IsLowercase}+", 0)
    return F.when(query == "", "").when(start != "", F.concat(F.lit("^"), bucket(start))).otherwise(F.concat(F.lit("."), F.substring(query, 1, 1)))


def member_batch(names_: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, symbol_ord) of frames (symbol_ord, name) and (query): the names that each query matches, case counting; the empty query matches all."""
    keyed = names_.where("name is not null").select("symbol_ord", "name", F.explode(member_keys(F.col("name"))).alias("key"))
    looked = queries.select("query").where("query is not null").distinct().select("query", member_key(F.col("query")).alias("key"), member_pattern(F.col("query")).alias("pattern"))
    # The keys of all names are many times the names, whatever the files' size says: they are never the side to broadcast.
    looked = Scratch(queries.sparkSession, "member-queries").save(looked, "looked")
    looked = F.broadcast(looked) if looked.count() <= BROADCAST_QUERIES else looked.hint("merge")
    return keyed.join(looked, "key").where(F.rlike("name", F.col("pattern"))).select("query", "symbol_ord")


def method_hits(methods: DataFrame, queries: DataFrame, sites: DataFrame) -> DataFrame:
    """(target, query, symbol, uri, ps, pe, rank) of queries (target, query): methods (symbol_ord, symbol, name) that match, at the sites (symbol_ord, target, uri, ps, pe) that the target sees, by symbol and place."""
    hits = member_batch(methods, queries).join(methods.select("symbol_ord", "symbol"), "symbol_ord").join(queries.distinct(), "query")
    found = hits.join(sites, ["symbol_ord", "target"]).select("target", "query", "symbol", "uri", "ps", "pe").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("target", "query").orderBy("symbol", "uri", "ps", "pe")))
