"""Grouped facts: rename profiles, block and interval statistics, epochs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import Scratch

BLOCK = 256


def rename_profiles(postings: DataFrame, groups: DataFrame, override_members: DataFrame) -> DataFrame:
    """One row for each group of (symbol_ord, component): counts, flags and the unsafe mask.

    override_members: (symbol_ord) of symbols that override or are overridden.
    """
    marked = groups.join(override_members.distinct().withColumn("o", F.lit(True)), "symbol_ord", "left")
    rows = marked.join(postings, "symbol_ord", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = rows.groupBy("component").agg(
        F.count_if(F.col("editable")).alias("editable_count"),
        some("generated").alias("has_generated"),
        some("readonly").alias("has_readonly"),
        some("dependency_source").alias("has_dependency"),
        some("o").alias("has_override_family"),
        (~some("is_def")).alias("is_external"),
    )
    bit = lambda c, b: F.when(F.col(c), b).otherwise(0)
    mask = bit("is_external", 1) + bit("has_generated", 2) + bit("has_readonly", 4) + bit("has_override_family", 8) + bit("has_dependency", 256)
    return out.withColumn("unsafe_mask", mask.cast("long"))


def _block(partition: list[str], order: list[str], size: int) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("int")


def block_stats(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """Per group and block of records in (doc, start, end, seq) order: counts, document range, targets."""
    rows = postings.withColumn("block_no", _block(["symbol_ord"], ["doc_ord", "ps", "pe", "seq"], size))
    return rows.groupBy("symbol_ord", "block_no").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("is_def")).alias("defs"),
        F.count_if(F.col("editable")).alias("editables"),
        F.min("doc_ord").alias("min_doc"),
        F.max("doc_ord").alias("max_doc"),
        F.array_join(F.sort_array(F.collect_set("target_ord")), ",").alias("targets"),
    )


def interval_stats(occurrences: DataFrame, size: int = BLOCK) -> DataFrame:
    """Per document and block of records in position order: first line, last end line, count."""
    rows = occurrences.withColumn("block_no", _block(["doc_ord"], ["ps", "pe", "seq"], size))
    return rows.groupBy("doc_ord", "block_no").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count("*").alias("records"))


def doc_epochs(docs: DataFrame, previous: DataFrame) -> DataFrame:
    """(uri, epoch, state) against the last generation's (uri, prev_epoch, prev_md5): new 1, same kept, changed one more."""
    rows = docs.select("uri", "md5").join(previous, "uri", "left")
    state = F.when(F.col("prev_epoch").isNull(), "new").when(F.col("md5") == F.col("prev_md5"), "same").otherwise("changed")
    epoch = F.when(F.col("prev_epoch").isNull(), 1).when(F.col("md5") == F.col("prev_md5"), F.col("prev_epoch")).otherwise(F.col("prev_epoch") + 1)
    return rows.select("uri", epoch.cast("int").alias("epoch"), state.alias("state"))


def primary_docs(docs: DataFrame) -> DataFrame:
    """The first of the documents that share a key: (md5, doc_id); docs: (md5, target_ord, doc_id)."""
    return docs.groupBy("md5").agg(F.min(F.struct("target_ord", "doc_id")).alias("x"), F.count("*").alias("copies")).select("md5", F.col("x.doc_id").alias("doc_id"), "copies")


def dense_ordinals(keys: DataFrame, column: str, buckets: int = 256, unique: bool = False) -> DataFrame:
    """(column, ordinal) over the distinct keys in byte order, from 0; with ``unique`` a repeated key is an error.

    Keys are dealt into ranges at sampled quantiles and written with the number
    of their range; each range is numbered by itself and shifted by the sizes
    of those before it, so no task sorts them all, whatever prefix they share.
    """
    counts = keys.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("#n"))
    twice = F.raise_error(F.concat(F.lit("repeated key "), F.col(column).cast("string"))).cast(keys.schema[column].dataType)
    parts = counts.select((F.when(F.col("#n") > 1, twice).otherwise(F.col(column)) if unique else F.col(column)).alias(column)).repartitionByRange(buckets, column)
    parts = Scratch(keys.sparkSession, "ordinals").save(parts.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row for each range
    inside = Window.partitionBy("part").orderBy(column)
    return parts.withColumn("at", F.row_number().over(inside)).join(F.broadcast(base), "part").select(column, (F.col("base") + F.col("at") - 1).cast("long").alias("ordinal"))


def rename_edits(postings: DataFrame, groups: DataFrame, profiles: DataFrame) -> DataFrame:
    """(component, uri, edits, n_edits) of the groups that are safe to rename; edits are distinct spans in order."""
    safe = profiles.where("unsafe_mask = 0").select("component")
    rows = postings.where("editable").join(groups, "symbol_ord").join(safe, "component", "left_semi")
    spans = rows.select("component", "uri", "ps", "pe").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ps", "pe"))), lambda s: F.concat_ws("-", s.ps, s.pe)), ",")
    return spans.groupBy("component", "uri").agg(text.alias("edits"), F.count("*").alias("n_edits"))


def agreement(postings: DataFrame) -> DataFrame:
    """Spans of a document at which targets see different sets of symbols: (doc_ord, ps, pe, n_sets)."""
    # A place is gathered once; its targets and their sets are told apart inside its row.
    seen = postings.groupBy("doc_ord", "ps", "pe").agg(F.collect_set(F.struct(F.col("target_ord").alias("t"), F.col("symbol_ord").alias("s"))).alias("x"))
    of = lambda t: F.array_sort(F.transform(F.filter("x", lambda y: y["t"].eqNullSafe(t) & y["s"].isNotNull()), lambda y: y["s"]))
    sets = F.transform(F.array_distinct(F.transform("x", lambda y: y["t"])), of)
    return seen.select("doc_ord", "ps", "pe", F.size(F.array_distinct(sets)).cast("long").alias("n_sets"))


def report(docs: DataFrame, occurrences: DataFrame, symbols: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of (name, n) about an ingest."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = one("documents", docs).union(one("occurrences", occurrences)).union(one("symbols", symbols))
    return out.union(groups.agg(F.count_distinct("component").alias("n")).select(F.lit("groups"), "n"))
