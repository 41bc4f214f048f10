"""Personal data: fixed base patterns, widened by bootstrapped contextual extraction.

Base spans come from four patterns and their checks.  They are seeds, and so
are long quoted strings of letters and digits, the seeds of a fifth kind,
``secret``, that has no base pattern.  The word to the left of a span, with its
digits as 0, is its lexical pattern; a word of punctuation alone counts with
the word before it ("token =").  Other tokens that look like an identifier of
the kind but are no seed are the candidates.  Spark scores the graph of
patterns and instances in rounds until nothing changes: a pattern's confidence
is the mean score of what follows its word anywhere in the corpus (words that
are no identifiers count as zero), an instance's score is the noisy-or of its
patterns; seeds stay at 1.  What follows a pattern with at least ``SEEDS``
different scored instances and a confidence of ``CONFIDENT`` becomes a span;
seeds of the fifth kind do so only there.  A word that ordinary text follows as
well never gets there, so clean documents gain nothing.

All work on texts is DataFrame expressions.  The positions of matches come
from the gaps between them: lengths are summed by a window for each document,
so a text with very many matches costs no more than its sort; windows over the
sorted spans also find which candidates touch a base span.  Patterns use
possessive repeats and begin at the start of a run (or where the last match
ended), which gives the leftmost matches in linear time.

Defined cases: a null text counts as empty and has no spans; rows with equal
doc_id and text are one document in the work and each keep their row; a null
doc_id is an id like any other; other columns are not read by ``find`` and kept
by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.rows import near
from plumbline.llm.text import GAP, lower_ascii
from plumbline.runtime import Scratch

SEEDS, CONFIDENT, BROADCAST_ROWS = 3, 0.8, 200_000
#: Rounds end when no confidence grows by more than ``STILL`` in sum; scores only rise, and far fewer than ``MOST_ROUNDS`` do it.
STILL, MOST_ROUNDS = 1e-6, 200
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"""(?<=["'])[A-Za-z0-9_+/=-]{32,}+(?=["'])""",
}
#: What a text must have for the base pattern to give a valid match: a cheap test before it.
_MAYBE = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "secret": r"""["'][A-Za-z0-9_+/=-]{32}"""}
#: Tokens that may be an identifier of the kind though the base pattern does not match; each is a whole token.
_LIKE = {
    "email": r"[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9.\[\]()-]+",
    "ip": r"[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}",
    "card": r"[0-9](?:[.\x20-]?[0-9]){11,18}",
    "phone": r"\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}",
}
_NONE = "array<struct<kind:int,i:int,gap:long,left:string,hit:string>>"
_CANDIDATE = {k: rf"(?<=[\x20\x09-\x0D])(?:{v})(?=[\x20\x09-\x0D.,;:!?]|$)" for k, v in _LIKE.items()}
_CANDIDATE["secret"] = r"""(?:(?<=[\x20\x09-\x0D])|(?<=[\x20\x09-\x0D]["']))(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+(?=["'\x20\x09-\x0D.,;:!?]|$)"""
_MAYBE_LIKE = {k: rf"[\x20\x09-\x0D](?:{v})" for k, v in _LIKE.items()} | {"secret": r"[A-Za-z_+/=-][0-9]|[0-9][A-Za-z_+/=-]"}
_G, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]++"
#: A word and the word of punctuation alone behind it, wherever one starts.
_PAIR = rf"(?=(?:(?<=[\x20\x09-\x0D])|^)([^\x20\x09-\x0D]++[\x20\x09-\x0D]++{_MARKS})(?:[\x20\x09-\x0D]|$))[^\x20\x09-\x0D]++"


def _plain(text: Column) -> Column:
    """Lower case, digits as 0, every gap character a space."""
    return F.translate(lower_ascii(F.coalesce(text, F.lit(""))), "123456789\t\n\x0b\x0c\r", "0" * 9 + " " * 5)


def _left(gap: Column) -> Column:
    """The pattern at the end of what stands before a span; empty if the span does not follow a gap, but for a quote."""
    back = F.reverse(gap)  # a pattern that starts at the end reads the end alone
    last = F.regexp_extract(back, rf"""^["']?{_G}++({_W}++)""", 1)
    before = F.regexp_extract(back, rf"""^["']?{_G}++{_W}++{_G}++({_W}++)""", 1)
    return _plain(F.reverse(F.when(F.rlike(last, F.lit(f"^{_MARKS}$")) & (before != ""), F.concat_ws(" ", last, before)).otherwise(last)))


def _matches(text: Column, pattern: str, maybe: str, kind: int) -> Column:
    """``(kind, i, gap, left, hit)`` of every match: characters since the last one, and what stands before it."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = F.transform(hits, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), _left(F.get(gaps, i)).alias("left"), h.alias("hit")))
    return F.when(F.rlike(text, F.lit(maybe)), every)


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        (kind == 0)
        | (kind == 1) & F.rlike(hit, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
        | (kind == 2) & F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
        | (kind == 3) & F.length(digits).between(9, 15)
        | (kind == SECRET) & F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[A-Za-z]"))
    )


def _placed(docs: DataFrame, patterns: dict[str, str], maybe: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """``(doc_id, h, kind, start, end, left, hit)`` of all matches; h: hash of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("t"))
    found = [_matches(F.col("t"), patterns[k], maybe[k], n) for n, k in enumerate(KINDS)]
    rows = rows.select("doc_id", "h", F.concat(*(F.coalesce(x, F.array().cast(_NONE)) for x in found)).alias("m"))
    rows = scratch.save(rows.where(F.size("m") > 0).dropDuplicates(["doc_id", "h"]), name)
    each = rows.select("doc_id", "h", F.inline("m"))
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(before))
    return each.select("doc_id", "h", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "left", "hit")


def _confident(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(kind, left)`` of the confident patterns among rows of (kind, left, hit, score)."""
    spark = docs.sparkSession
    graph = found.where("left <> ''").groupBy("kind", "left", "hit").agg(F.max("score").alias("base"), F.count("*").alias("n"))
    graph = scratch.save(graph, "graph")
    lefts = graph.groupBy("kind", "left").agg(F.count("*").alias("c")).where(F.col("c") >= SEEDS).select("left").distinct()
    lefts = scratch.save(lefts, "lefts")
    some = lefts.limit(BROADCAST_ROWS + 1).count()
    if not some:
        return spark.createDataFrame([], "kind int, left string")
    plain = docs.select(_plain(F.col("text")).alias("t"))
    pairs = plain.where(F.rlike("t", F.lit(f"{_G}{_MARKS}(?:{_G}|$)"))).select(F.explode(F.regexp_extract_all("t", F.lit(_PAIR), F.lit(1))).alias("left"))
    words = plain.select(F.explode(F.split("t", " +")).alias("left")).union(pairs.select(F.regexp_replace("left", " +", " ")))
    if some <= BROADCAST_ROWS:
        words = words.join(F.broadcast(lefts), "left", "left_semi")  # BROADCAST_ROWS patterns at most
    met = words.groupBy("left").agg(F.count("*").alias("all")).join(lefts, "left", "left_semi")
    met = scratch.save(met, "met")
    scored, last = graph.withColumn("score", F.col("base")), (0, -1.0)
    for n in range(MOST_ROUNDS):
        confident = scored.groupBy("kind", "left").agg(F.sum(F.col("n") * F.col("score")).alias("s"), F.count_if(F.col("score") >= CONFIDENT).alias("c")).join(met, "left")
        confident = confident.select("kind", "left", (F.col("s") / F.greatest("all", F.col("s"))).alias("conf"), "c").where((F.col("c") >= SEEDS) & (F.col("conf") >= CONFIDENT))
        patterns = scratch.save(confident.select("kind", "left", "conf"), f"patterns-{n}")
        now = tuple(patterns.agg(F.count("*"), F.coalesce(F.sum("conf"), F.lit(0.0))).first())
        if now[0] == last[0] and now[1] <= last[1] + STILL or not now[0]:
            return patterns.select("kind", "left")
        last = now
        loss = F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9))))
        noisy = graph.join(patterns, ["kind", "left"]).groupBy("kind", "hit").agg((1 - F.exp(loss)).alias("by"))
        scored = scratch.save(graph.join(noisy, ["kind", "hit"], "left").withColumn("score", F.greatest("base", F.coalesce("by", F.lit(0.0)))).select("kind", "left", "hit", "n", "base", "score"), f"scored-{n}")
    raise RuntimeError(f"confidences still change after {MOST_ROUNDS} rounds")


def spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, kind, start, end, base)``: every span of every different document."""
    scratch = Scratch(docs.sparkSession, "pii")
    columns = ["doc_id", "h", "kind", "start", "end"]
    hits = _placed(docs, _BASE, _MAYBE, scratch, "matches")
    seeds = scratch.save(hits.where(_valid(F.col("kind"), F.col("hit"))).withColumn("score", F.lit(1.0)), "seeds")
    like = _placed(docs, _CANDIDATE, _MAYBE_LIKE, scratch, "like").where((F.col("kind") != SECRET) | _valid(F.col("kind"), F.col("hit"))).withColumn("score", F.lit(0.0))
    each = seeds.union(like).groupBy(*columns).agg(F.max("score").alias("score"), F.first("left").alias("left"), F.first("hit").alias("hit"))
    each = each.withColumn("base", (F.col("score") == 1) & (F.col("kind") < SECRET))
    # A candidate touches a base span that starts at or before it and ends in it or behind it, or one that starts inside it.
    along = Window.partitionBy("doc_id", "h").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("touches", (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end")))
    each = scratch.save(each.where("base or not touches").drop("touches"), "apart")
    patterns = _confident(each, docs, scratch)
    more = each.where("not base").join(patterns, ["kind", "left"], "left_semi")
    return scratch.save(each.where("base").select(*columns, "base").union(more.select(*columns, "base")), "spans")


def _joined(only_base: bool) -> Column:
    rows = F.collect_list(F.when(F.col("base") | F.lit(not only_base), F.struct("start", "kind", "end")))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans)`` of every row; the four counts are of base spans, the last one of all."""
    counts = [*(F.count_if((F.col("kind") == n) & F.col("base")).alias(f"n_{k}") for n, k in enumerate(KINDS[:SECRET])), F.count_if(F.col("kind") == SECRET).alias("n_secret"), F.count("*").alias("n_spans")]
    each = spans(docs).groupBy("doc_id", "h").agg(*counts, _joined(True).alias("own"), _joined(False).alias("spans"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("g"))
    rows = rows.join(each, F.expr("id <=> doc_id and g = h"), "left")
    found = {k: F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in (*KINDS, "spans")}
    return rows.select(F.col("id").alias("doc_id"), *(found[k] for k in KINDS[:SECRET]), F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), found["secret"], found["spans"])


def redact(docs: DataFrame) -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first. ``n_chars``, where there is one, follows the text."""
    found = spans(docs)
    order = Window.partitionBy("doc_id", "h").orderBy("start", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(-1))).cast("int"))
    merged = merged.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    cuts = merged.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("#cuts"))
    cuts = near(Scratch(docs.sparkSession, "pii").save(cuts.select(F.col("doc_id").alias("#id"), F.col("h").alias("#h"), "#cuts"), "cuts"), found.count())
    rows = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("#id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("#h")), "left")
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def piece(c: Column, i: Column) -> Column:
        since = F.coalesce(F.get(F.col("#cuts"), i - 1)["end"], F.lit(0))
        return F.concat(F.substring(docs["text"], since.cast("int") + 1, (c["start"] - since).cast("int")), F.get(names, c["kind"]))

    tail = F.substring(docs["text"], F.element_at("#cuts", -1)["end"].cast("int") + 1, F.length(docs["text"]))
    text = F.when(F.col("#cuts").isNull(), docs["text"]).otherwise(F.concat(F.array_join(F.transform("#cuts", piece), ""), tail))
    given = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    rows = rows.select(*given)
    return rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else rows
