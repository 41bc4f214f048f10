"""The folds over projection E, as tables; each has a streaming twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import projections as p
from plumbline.plans.queries import query
from plumbline.streaming import folds

SIX_HOURS = 6 * 3600 * 1000


def _list(message):
    return F.concat(F.lit('["'), message, F.lit('"]'))


@query("note", """
select uri, seq, case when kind <> 'close' then seq end as version, case when kind <> 'close' then message end as text from note where kind in ('open', 'change', 'close')""")
def buffer_fold(spark, sf_dir):
    """Open buffers: every change replaces the whole text here; ranged edits are tested by hand."""
    edits = F.concat(F.lit('[{"text":"'), "message", F.lit('"}]'))
    events = p.notifications(spark, sf_dir).select("uri", "seq", "kind", F.col("seq").alias("version"), edits.alias("edits"))
    return folds.batch(events, "uri", "seq", folds.buffer_fold, "seq long, version long, text string")


@query("note", """
, req as (select uri, epoch_us(ts) // 1000 "at", kind = 'save' c from note where kind in ('change', 'save')),
r as (select uri, min("at") opened from req group by uri
  union all select r.uri, min(req."at") from r join req on req.uri = r.uri and req."at" >= r.opened + 21600000 group by r.uri, r.opened)
select r.uri, opened, count(*) n, bool_or(c) compile_first from r join req on req.uri = r.uri and req."at" >= opened and req."at" < opened + 21600000 group by 1, 2""")
def debounced_builds(spark, sf_dir):
    events = p.notifications(spark, sf_dir).where("kind in ('change', 'save')")
    # Whole milliseconds, as a clock gives them.
    events = events.select("uri", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("kind") == "save").alias("compile"))
    return folds.batch(events, "uri", "seq", folds.debounce_fold(SIX_HOURS), "opened long, n long, compile_first boolean", folds.debounce_end)


@query()
def diagnostics_router(spark, sf_dir):
    """Compared with a brute-force version in the tests."""
    events = p.notifications(spark, sf_dir).where("kind = 'publish'")
    messages = F.when(F.col("seq") % 5 == 0, "[]").otherwise(_list(F.col("message")))
    events = events.select("uri", "seq", F.col("target").cast("string").alias("target"), "reset", messages.alias("messages"))
    return folds.batch(events, "uri", "seq", folds.router_fold, "seq long, diagnostics string")


@query("note", """
, e as (select *, case kind when 'publish' then 'build' when 'change' then 'typing' else 'drop' end k from note where kind in ('publish', 'change', 'save', 'close')),
f as (select *, last_value(case when k = 'build' then message end ignore nulls) over w b, max(case when k <> 'typing' then seq end) over w cut, max(case when k = 'typing' then seq end) over w t,
  last_value(case when k = 'typing' then message end ignore nulls) over w tm from e window w as (partition by uri order by seq))
select uri, seq, '[' || concat_ws(', ', '"' || b || '"', case when t is not null and t > coalesce(cut, -1) then '"' || tm || '"' end) || ']' diagnostics from f""")
def two_layer_diagnostics(spark, sf_dir):
    kinds = F.when(F.col("kind") == "publish", "build").when(F.col("kind") == "change", "typing").otherwise("drop")
    events = p.notifications(spark, sf_dir).where("kind in ('publish', 'change', 'save', 'close')")
    events = events.select("uri", "seq", kinds.alias("kind"), _list(F.col("message")).alias("messages"))
    return folds.batch(events, "uri", "seq", folds.layers_fold, "seq long, diagnostics string")


@query("note", """select uri, target, string_agg(message, ',' order by seq) messages, count(*) n from note where kind = 'publish' group by uri, target""")
def merged_diagnostics(spark, sf_dir):
    rows = p.notifications(spark, sf_dir).where("kind = 'publish'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x.message), ",")
    return rows.groupBy("uri", "target").agg(text.alias("messages"), F.count("*").alias("n"))
