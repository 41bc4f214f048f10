"""Queries about the workspace, over projections L and E."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import masks
from plumbline.operators import session
from plumbline.plans import projections as p
from plumbline.plans.queries import L, query


@query("occ", """
, hit as (select 1 pri, * from occ where doc_ord % 7 = 0 and symbol_ord % 2 = 0 union all select 2, * from occ where doc_ord % 3 <> 0 union all select 3, * from occ where symbol_ord % 5 <> 0),
ask as (select distinct doc_ord, ps "at" from occ),
best as (select a.doc_ord, a."at", arg_min(h, (h.pri, h.pe - h.ps, h.ps, h.seq)) b from ask a join hit h on a.doc_ord = h.doc_ord and a."at" between h.ps and h.pe group by 1, 2)
select ask.doc_ord, ask."at", b.symbol_ord, b.ps, b.pe, case b.pri when 1 then 'overlay' when 2 then 'snapshot' when 3 then 'raw' else 'NoSymbolAtCursor' end source
from ask left join best on ask.doc_ord = best.doc_ord and ask."at" = best."at\"""")
def cursor_routing(spark, sf_dir):
    """Overlay, snapshot and raw facts are parts of the occurrences here."""
    l = L(spark, sf_dir)
    cursors = l.occ.select("doc_ord", F.col("ps").alias("at"))
    return session.route_cursors(cursors, l.occ, l.occ.where("doc_ord % 7 = 0 and symbol_ord % 2 = 0"), l.occ.where("symbol_ord % 5 <> 0"), l.docs.where("doc_ord % 3 = 0"))


@query("note", """
, b as (select uri, arg_max(message, seq) as text from note where kind in ('open', 'change') group by uri), d as (select uri, arg_max(message, seq) as saved from note where kind = 'save' group by uri)
select uri, text is distinct from saved dirty from b left join d using (uri)""")
def dirty_buffers(spark, sf_dir):
    notes = p.notifications(spark, sf_dir)
    latest = lambda *kinds: notes.where(F.col("kind").isin(*kinds)).groupBy("uri").agg(F.max_by("message", "seq").alias("text"))
    return session.dirty(latest("open", "change"), latest("save"))


@query("note doc closure", "select seq, c.source target_ord from note join doc on doc.doc_ord = note.seq join closure c on c.reached = doc.target_ord where kind = 'save'")
def compile_domain(spark, sf_dir):
    """Saves of the events; the document with the event's number is the saved one."""
    l = L(spark, sf_dir)
    saves = p.notifications(spark, sf_dir).where("kind = 'save'").select("seq", F.concat(F.lit("orders/"), F.col("seq").cast("string")).alias("uri"))
    return session.compile_domain(saves, l.docs, l.closure)


@query("target doc", """
, s as (select target_ord, count(*) documents, count(*) filter (where md5 <> prev_md5) stale, count(*) filter (where prev_md5 is null) as unknown from doc group by 1)
select bsp_id, '{"documents":' || coalesce(documents, 0) || ',"stale":' || coalesce(stale, 0) || ',"unknown":' || coalesce(unknown, 0) || ',"status":"' ||
  case when coalesce(documents, 0) = 0 then 'empty' when stale > 0 then 'stale' else 'fresh' end || '"}' report from target left join s using (target_ord)""")
def doctor_report(spark, sf_dir):
    l = L(spark, sf_dir)
    state = F.when(F.col("prev_md5").isNull(), "MissingMd5").when(F.col("md5") == F.col("prev_md5"), "Fresh").otherwise("Stale")
    return session.doctor(l.targets, l.docs.withColumn("state", state))


@query("", "select upper(md5(text)) uri, min(substr(source, 4)::int) target_ord, count(*) copies from documents group by 1")
def spec_of(spark, sf_dir):
    docs = p.table(spark, sf_dir, "documents").select(masks.checksum(F.col("text")).alias("uri"), F.substring("source", 4, 9).cast("int").alias("target_ord"))
    return session.spec_of(docs)


@query("", """
with u as (select distinct source || '/' || lang || '/' || doc_id uri, source, lang, doc_id from documents)
select uri, case when doc_id % 4 = 0 then 100 when lang = 'en' then 2 when source <> 'src3' then 1 end target_ord from u""")
def requesting_target(spark, sf_dir):
    """Every fourth document has a target of its own; the rest go by the deepest of the roots."""
    uri = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    rows = p.table(spark, sf_dir, "documents").select(uri.alias("uri"), "source", "lang", "doc_id")
    roots = rows.where("source <> 'src3'").select(F.col("source").alias("root"), F.lit(1).alias("target_ord")).union(rows.where("lang = 'en'").select(F.concat_ws("/", "source", "lang"), F.lit(2))).distinct()
    return session.requesting_target(rows.select("uri"), rows.where("doc_id % 4 = 0").select("uri", F.lit(100).alias("target_ord")), roots)
