"""One job from decoded fact documents to the tables of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.masks import flag_word, freshness
from plumbline.functions.position import unpack_char, unpack_line
from plumbline.operators import families, rename
from plumbline.operators.aggregates import dense_ordinals, doc_epochs
from plumbline.plans.components import connected_components
from plumbline.runtime import Scratch
from plumbline.sources import facts


def ingest(decoded: DataFrame, doc_facts: DataFrame, previous: DataFrame | None = None, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables doc, symbol, occurrence, rename, profile and report.

    decoded: documents as ``facts.decode`` gives them, with target_ord;
    doc_facts: (uri, generated, readonly, dependency_source), absent means
    false; previous: (uri, prev_epoch, prev_md5) of the last generation; skipped:
    (uri) without a source, which ``facts.with_texts`` tells, for the report.
    rename holds the editable occurrences whose source shows the expected token;
    a profile's mask says what the symbols of its group are, as ``families.masks`` does.
    """
    spark = decoded.sparkSession
    scratch = Scratch(spark, "ingest")
    rows = scratch.save(decoded, "decoded")
    good = rows.where("error is null")
    first = scratch.save(facts.primary(good), "primary")
    previous = spark.createDataFrame([], "uri string, prev_epoch int, prev_md5 string") if previous is None else previous
    no = F.lit(False)
    docs = first.select("uri", "target_ord", "md5", freshness(F.col("text"), F.col("md5")).alias("state")).join(doc_facts, "uri", "left")
    docs = docs.join(doc_epochs(first.select("uri", "md5"), previous).select("uri", "epoch"), "uri").join(dense_ordinals(first, "uri").withColumnRenamed("ordinal", "doc_ord"), "uri")
    docs = scratch.save(docs.withColumns({c: F.coalesce(c, no) for c in ("generated", "readonly", "dependency_source")}), "doc")

    infos, occ = scratch.save(facts.symbol_infos(first), "infos"), scratch.save(facts.occurrence_rows(first), "occurrences")
    keys = scratch.save(infos.select("symbol").union(occ.select("symbol")).distinct(), "keys")
    defined = occ.where("is_def").select("symbol").distinct()
    lost = scratch.save(facts.forwarders(infos.where("kind = 3"), defined), "forwarders")
    edges = facts.alias_edges(keys).union(lost)
    groups = connected_components(edges.union(keys.select(F.col("symbol").alias("u"), F.col("symbol").alias("v"))))
    names = dense_ordinals(keys, "symbol").withColumnRenamed("ordinal", "symbol_ord")
    display = infos.groupBy("symbol").agg(F.min_by("display", "uri").alias("display"), F.min_by("kind", "uri").alias("kind"))
    symbols = names.join(groups.select(F.col("node").alias("symbol"), F.col("component").alias("group_symbol")), "symbol").join(display, "symbol", "left")
    symbols = scratch.save(symbols, "symbol")

    posts = occ.join(symbols.select("symbol", "symbol_ord", "group_symbol"), "symbol").join(docs.select("uri", "doc_ord", "target_ord", "epoch", "generated", "readonly", "dependency_source"), "uri")
    editable = ~(F.col("generated") | F.col("readonly") | F.col("dependency_source"))
    posts = scratch.save(posts.withColumn("editable", editable).withColumn("flags", flag_word(F.col("is_def"), editable, F.col("generated"), F.col("readonly"))), "occurrence")
    lines = first.select("uri", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    shown = posts.where("editable").withColumn("line", unpack_line("ps")).join(lines, ["uri", "line"]).join(symbols.select("symbol", "display"), "symbol")
    token = rename.token_matches(F.col("content"), unpack_char("ps"), unpack_char("pe"), unpack_line("pe") == F.col("line"), rename.expected_token(F.col("symbol"), F.col("display")))
    renames = scratch.save(shown.where(token).select("group_symbol", "uri", "ps", "pe", "target_ord", "epoch"), "rename")

    some = lambda c: F.coalesce(F.bool_or(c), no)
    profile = posts.groupBy("group_symbol").agg(F.count_if("editable").alias("editable_count"), some("generated").alias("has_generated"), some("readonly").alias("has_readonly"), (~some("is_def")).alias("is_external"))
    members = symbols.select("symbol", F.col("group_symbol").alias("component"))
    mask = families.masks(members, families.inverted(infos), lost, infos).toDF("group_symbol", "mask")
    profile = profile.join(mask, "group_symbol", "left").join(renames.groupBy("group_symbol").agg(F.count("*").alias("rename_count")), "group_symbol", "left").fillna(0, ["mask", "rename_count"])

    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counted = {
        "documents": docs,
        "stale": good.where(freshness(F.col("text"), F.col("md5")) != "Fresh"),
        "errors": rows.where("error is not null"),
        "symbols": symbols,
        "groups": symbols.select("group_symbol").distinct(),
        "occurrences": posts,
        "rename_tokens": renames,
    }
    if skipped is not None:
        counted["skipped"] = skipped
    report = good.agg(F.count("*").alias("all")).crossJoin(docs.agg(F.count("*").alias("first"))).select(F.lit("shared").alias("name"), (F.col("all") - F.col("first")).alias("n"))  # one row each
    for name, df in counted.items():
        report = report.union(count(name, df))
    return {"doc": docs, "symbol": symbols, "occurrence": posts, "rename": renames, "profile": profile, "report": report}
