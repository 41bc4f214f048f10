"""Queries about open buffers, raw facts, roots, watched files and results, over the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import text, workspace
from plumbline.plans import projections as p
from plumbline.plans.queries import L, query
from plumbline.runtime import Scratch
from plumbline.sources import layout
from plumbline.streaming import folds

SIX_HOURS = 6 * 3600 * 1000


@query("line", r"""
, at as (select doc_id, line, content, least(length(content), doc_id % 60) c from line where not regexp_matches(content, '[\x{10000}-\x{10FFFF}]')),
s as (select *, length(regexp_extract(left(content, c), '[\p{L}\p{N}_$]*$')) l, length(regexp_extract(substr(content, c + 1), '^[\p{L}\p{N}_$]*')) r from at)
select doc_id, line, c - l as start, c + r as "end" from s where l + r > 0""".replace(", at as", ", spot as").replace("from at)", "from spot)"))
def identifier_spans(spark, sf_dir):
    """The identifier at a column of every line."""
    rows = p.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).where(~F.rlike("content", F.lit(r"[\x{10000}-\x{10FFFF}]")))
    found = rows.select("doc_id", F.col("line").cast("long").alias("line"), workspace.identifier_span(F.col("content"), (F.col("doc_id") % 60).cast("int")).alias("x"))
    return found.where("x is not null").select("doc_id", "line", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query("posting", """
, raw as (select uri, symbol_ord symbol, ps, pe, is_def from posting where doc_ord % 5 <> 0),
ask as (select distinct uri, symbol_ord symbol from posting),
st as (select uri, case when doc_ord % 5 = 0 then case when doc_ord % 2 = 0 then 'NoSemanticdb' else 'NotIndexed' end when md5 = prev_md5 then 'ok' else 'StaleIndex' end status from doc where doc_ord in (select doc_ord from posting))
select ask.uri, ask.symbol, ps, pe, is_def, status from ask join st using (uri) left join raw on raw.uri = ask.uri and raw.symbol = ask.symbol and status = 'ok'""")
def raw_occurrences(spark, sf_dir):
    """Every symbol's occurrences in the raw facts of its own documents, where these are fresh."""
    l = L(spark, sf_dir)
    rows = l.postings.select("doc_ord", "uri", F.col("symbol_ord").alias("symbol"), "ps", "pe", "is_def", F.upper("prev_md5").alias("md5"))
    status = p.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_ord"), F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("text"))
    texts = l.docs.select("doc_ord", "uri").join(status, "doc_ord").select("uri", "text")
    sources = l.docs.where("doc_ord % 2 = 0").select("uri")
    return workspace.raw_fallback(rows.select("uri", "symbol").distinct(), rows.where("doc_ord % 5 <> 0").drop("doc_ord"), texts, sources)


@query("doc", "select 'orders/' || (o_orderkey * 2) uri, o_orderkey * 2 in (select o_orderkey from orders) active from orders")
def active_documents(spark, sf_dir):
    l = L(spark, sf_dir)
    return workspace.active(l.docs.select(F.concat(F.lit("orders/"), (F.col("doc_ord") * 2).cast("string")).alias("uri")), l.docs)


@query("nest", """
select symbol, kind from (select distinct symbol, case when symbol like '%).' then 3 when right(symbol, 1) = '#' then 13 when length(symbol) % 3 = 0 then 3 else 10 end kind from nest where is_def)""")
def searchable_symbols(spark, sf_dir):
    defined = Scratch(spark, "searchable").save(p.nested_defined(spark, sf_dir), "defined")
    return workspace.searchable(p.nested_kinds(defined), defined).select("symbol", "kind")


@query("", """
with f as (select distinct 'file:///w/' || source || '/' || lang || '/d' || doc_id uri, '/w/' || source || '/' || lang || '/d' || doc_id file, source, lang, doc_id from documents)
select uri, case when doc_id % 3 = 0 then source || '/' || lang || '/d' || doc_id when lang in ('en', 'de') then 'd' || doc_id else lang || '/d' || doc_id end path from f""")
def paths_below_roots(spark, sf_dir):
    """Document paths below the deepest root, unless a less deep one gives a known path."""
    rows = p.table(spark, sf_dir, "documents").select("source", "lang", "doc_id").distinct()
    files = rows.select(F.concat(F.lit("file:///w/"), F.concat_ws("/", "source", "lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("uri"))
    roots = rows.select(F.concat(F.lit("/w/./"), "source").alias("root")).union(rows.where("lang in ('en', 'de')").select(F.concat(F.lit("/w/"), F.concat_ws("/", "source", "lang"), F.lit("/")))).union(rows.select(F.lit("/w/x/.."))).distinct()
    known = rows.where("doc_id % 3 = 0").select(F.concat(F.concat_ws("/", "source", "lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("path"))
    return workspace.below_roots(files, roots, known)


@query("", r"""
with e as (select event_id // 50 batch, case event_type when 'click' then '/w/a/T' || user_id || '.semanticdb' when 'view' then '/w/.bsp/c.json' when 'error' then '/w/.workspace/config.json' else '/w/src/x.bsp/y.txt' end path from events),
c as (select batch, count(*) filter (where path like '%.semanticdb') facts, count(*) filter (where path like '%/config.json') config, count(*) filter (where path like '%/.bsp/%.json') connection, count(*) filter (where path like '%.txt') as unmatched from e group by 1)
select *, coalesce(nullif(concat_ws(', ', case when facts > 0 then 'reindex scheduled' end, case when config > 0 then 'pc config re-read' end, case when connection > 0 then 'bsp change logged' end), ''), 'no action') actions from c""")
def watched_files(spark, sf_dir):
    """Batches of file events and what they lead to."""
    kinds = F.when(F.col("event_type") == "click", F.concat(F.lit("/w/a/T"), F.col("user_id").cast("string"), F.lit(".semanticdb"))).when(F.col("event_type") == "view", "/w/.bsp/c.json").when(F.col("event_type") == "error", "/w/.workspace/config.json").otherwise("/w/src/x.bsp/y.txt")
    return workspace.watched(p.table(spark, sf_dir, "events").select(F.expr("event_id div 50").alias("batch"), kinds.alias("path")))


@query("note", """
, e as (select *, sum((kind = 'close')::int) over (partition by uri order by seq) life from note where kind in ('change', 'close'))
select uri, seq, row_number() over (partition by uri, life order by seq)::int result_id from e where kind = 'change'""")
def result_counters(spark, sf_dir):
    """Numbers of a document's token results."""
    return workspace.result_counters(p.notifications(spark, sf_dir).where("kind in ('change', 'close')").select("uri", "seq", "kind"))


@query("note", """
, e as (select uri, epoch_us(ts) // 1000 t, kind from note where kind in ('change', 'save', 'close')),
c as (select uri, t from e where kind <> 'change'),
r as (select uri, min(t) armed from e where kind = 'change' group by uri
  union all select r.uri, min(e.t) from r join e on e.uri = r.uri and e.kind = 'change' and e.t > r.armed and e.t >= least(r.armed + 21600000, coalesce((select min(c.t) from c where c.uri = r.uri and c.t > r.armed), 9223372036854775807)) group by r.uri, r.armed)
select uri, armed, armed + 21600000 due from r where not exists (select 1 from c where c.uri = r.uri and c.t >= r.armed and c.t < r.armed + 21600000)""")
def typing_pulls(spark, sf_dir):
    """Pulls that changes arm and saves or closes disarm, with a window of six hours here."""
    events = p.notifications(spark, sf_dir).where("kind in ('change', 'save', 'close')").select("uri", "seq", "kind", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return folds.batch(events, "uri", "seq", folds.pull_fold(SIX_HOURS), "armed long, due long", folds.pull_end(SIX_HOURS))


@query()
def token_results(spark, sf_dir):
    """Answers from the cache of a session's latest results; compared with a brute-force version in the tests."""
    events = p.notifications(spark, sf_dir).where("kind in ('change', 'open', 'close')")
    events = events.select(F.col("target").cast("string").alias("session"), "seq", "uri", F.when(F.col("kind") == "close", "close").otherwise("request").alias("kind"), (F.col("seq") % 4).alias("previous"))
    return folds.batch(events, "session", "seq", folds.cache_fold(32), "seq long, result_id long, delta boolean")


@query("posting", """
, b as (select symbol_ord, doc_ord, ps, pe, target_ord, ((row_number() over (partition by symbol_ord order by doc_ord, ps, pe, seq) - 1) // 8)::int block_no from posting)
select symbol_ord, block_no, doc_ord, ps, pe from b semi join (select distinct symbol_ord, block_no from b where target_ord = 7) k using (symbol_ord, block_no)""")
def blocks_of_target(spark, sf_dir):
    """The records of the blocks that hold a target, by the index of blocks."""
    tables = layout.by_group(L(spark, sf_dir).postings, 8, 8)
    found = layout.records(tables["group_posting"], layout.blocks_with_target(tables["block_index"], 7), "symbol_ord")
    return found.select("symbol_ord", "block_no", "doc_ord", "ps", "pe")


@query("", """
with d as (select doc_id, string_split(text, ' ') a, string_split(lead(text) over (partition by source order by doc_id), ' ') b from documents),
p as (select *, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true), 0), least(len(a), len(b)) + 1) - 1 start from d where b is not null and a <> b),
q as (select *, least(len(a), len(b)) - start m, coalesce(nullif(list_position(list_transform(range(0, least(len(a), len(b)) - start), lambda i: a[len(a) - i] <> b[len(b) - i]), true), 0), least(len(a), len(b)) - start + 1) - 1 tail from p)
select doc_id, start::int start, (len(a) - start - tail)::int removed, array_to_string(b[start + 1:len(b) - tail], ' ') added from q""")
def token_splice(spark, sf_dir):
    """The one edit between each document and the next of its source."""
    docs = p.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pairs = text.following(docs, "source", "doc_id", "text", p.shares(docs))
    return text.splice(pairs.where("text is not null and next is not null").select("doc_id", F.split("text", " ").alias("a"), F.split("next", " ").alias("b")))
