"""What a plan repeats, shuffles or holds for each row, where that once grew out of bounds."""

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

import plumbline.plans.navigation_queries  # noqa: F401  registers its own
import plumbline.plans.search_queries  # noqa: F401
import plumbline.plans.workspace_queries  # noqa: F401
from plumbline.operators import aggregates, lookup, references, search_index, session, text
from plumbline.plans import projections
from plumbline.plans.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_closure_of_a_target_is_gathered_once(spark):
    """Most documents have one target, and all lie below one root."""
    uris = spark.createDataFrame([("orders/1",), ("orders/2",), ("x/3",)], "uri string")
    own = spark.createDataFrame([("orders/1", 1)], "uri string, target_ord int")
    roots = spark.createDataFrame([("orders", 2)], "root string, target_ord int")
    closure = spark.createDataFrame([(1, 1), (1, 0), (2, 2)], "source int, reached int")
    asked = session.requesting_target(uris, own, roots)
    got = session.closures_seen(asked, closure)
    assert sorted(tuple(r) for r in got.collect()) == [("orders/1", 2, [0, 1]), ("orders/2", 1, [2])]
    assert "BroadcastHashJoin" in plan(got) and not any("hashpartitioning(root" in x or "hashpartitioning(target_ord" in x for x in plan(got).split("\n"))


def test_answers_are_found_inside_the_row_of_a_place(spark):
    """A reference goes before a definition, unseen targets give no answer, and nothing is grouped again."""
    postings = spark.createDataFrame([(1, "u", 1, 2, True, 1), (1, "u", 1, 2, False, 2), (2, "u", 1, 2, True, 2), (2, "v", 3, 4, True, 9)], "symbol_ord int, uri string, ps long, pe long, is_def boolean, target_ord int")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "symbol_ord int, component int")
    viewer = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "symbol_ord int, component int, def_target int")
    closure = spark.createDataFrame([(1, 1), (1, 0), (2, 2), (2, 0)], "source int, reached int")
    found = references.places(groups, postings)
    assert {r["uri"]: [tuple(t) for t in r["targets"]] for r in found.collect()} == {"u": [(1, True), (2, False)], "v": [(9, True)]}
    got = references.answers(found, viewer, closure)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "u", 1, 2, False), (1, 1, "u", 1, 2, True)]
    assert "def_target" not in "".join(x for x in plan(references.answers(found, viewer, closure)).split("\n") if "hashpartitioning" in x and "uri" in x)


def test_the_sets_of_a_place_are_compared_inside_its_row(spark):
    """One grouping by place, not by place, target and set."""
    rows = spark.createDataFrame([(1, 1, 2, 5, 7), (1, 1, 2, 5, 8), (1, 1, 2, 6, 8), (1, 1, 2, 6, 7), (1, 1, 2, 9, 7), (1, 3, 4, 5, 7)], "doc_ord int, ps int, pe int, target_ord int, symbol_ord int")
    got = aggregates.agreement(rows)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2, 2), (1, 3, 4, 1)]
    assert plan(aggregates.agreement(rows)).count("Exchange ") == 1


def test_a_cursor_is_repeated_for_few_sizes(spark):
    """The three sources are asked by one join, and cursors without a hit need none."""
    spans = spark.range(1, 5001).select(F.col("id").alias("seq"), F.lit(1).alias("doc_ord"), F.col("id").alias("symbol_ord"), F.lit(100).cast("long").alias("ps"), (F.col("id") + 100).alias("pe"))
    cursors = spark.createDataFrame([(1, at) for at in (99, 100, 150, 5000, 5100, 5101)] * 2, "doc_ord int, at long")
    got = lookup.symbol_at(spans, cursors)
    assert sorted(tuple(r) for r in got.select("at", "symbol_ord").collect()) == [(100, 1), (150, 50), (5000, 4900), (5100, 5000)]
    stale = spark.createDataFrame([(1,)], "doc_ord int")
    routed = session.route_cursors(cursors, spans, spans.where("seq > 4950"), spans.where("seq < 4950"), stale)
    assert sorted((r["at"], r["symbol_ord"], r["source"]) for r in routed.collect()) == [(99, None, "NoSymbolAtCursor"), (100, 4951, "overlay"), (150, 4951, "overlay"), (5000, 4951, "overlay"), (5100, 5000, "overlay"), (5101, None, "NoSymbolAtCursor")]
    assert routed._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # the other leaves stale documents out


def test_symbols_and_definitions_without_places(spark):
    """The short ways give what the whole projection gives, and sort no words."""
    small = "/root/testdata/sf0.001"
    occ = projections.nested(spark, small).cache()
    same = lambda a, b: a.count() == b.count() and not a.exceptAll(b).count()
    assert same(projections.nested_symbols(spark, small), occ.select("symbol").distinct())
    assert same(projections.nested_defined(spark, small), occ.where("is_def").select("symbol").distinct())
    tops = occ.where("is_def and length(symbol) = 5").groupBy("doc", "target", "symbol").agg(F.min("ps").alias("ps"))
    assert same(projections.nested_tops(spark, small).select("doc", "target", "symbol", "ps"), tops)
    for f in (projections.nested_symbols, projections.nested_defined, projections.nested_tops):
        assert "Window" not in plan(f(spark, small))


def test_words_stay_where_their_texts_are(spark):
    """The texts are dealt once; spans, entries and references are not shuffled."""
    small = "/root/testdata/sf0.001"
    for name in ("selection_chains", "enclosing_definition"):
        assert plan(QUERIES[name](spark, small)).count("Exchange ") == 1


def test_a_pair_of_prefix_and_symbol_is_found_once(spark):
    """Tokens of a symbol that share a bucket stand in one row of it, so no task tells pairs apart."""
    known = spark.createDataFrame([(1, ["blue", "blush", "bolt"]), (2, ["b", "blueish"]), (3, ["ring"]), (4, [])], "symbol_ord long, tokens array<string>")
    asked = spark.createDataFrame([(q,) for q in ("b", "bl", "blu", "blue", "blues", "bluei", "ri", "x", "", None, "b")], "q string")
    got = search_index.prefix_join(asked, known)
    want = [("b", 1), ("b", 2), ("bl", 1), ("bl", 2), ("blu", 1), ("blu", 2), ("blue", 1), ("blue", 2), ("bluei", 2), ("ri", 3)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Aggregate" not in plan(got) and "SortMergeJoin" not in plan(got)
    of_query = plan(QUERIES["prefix_join"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(q" not in of_query and "hashpartitioning(bucket" not in of_query


def test_the_next_row_is_found_in_blocks_of_a_group(spark):
    """No task reads a whole group, and gaps, equal places and rows without a number or a group are no exception (F32)."""
    ids = [-3000, -1, 0, 1, 1022, 1023, 1024, 1025, 5000, 9000, 9001, 20480]
    rows = [("a", i) for i in ids] + [("b", 7), (None, 5), (None, 3000), ("a", None), ("c", None)]
    docs = spark.createDataFrame([(g, i, f"{g}{i}") for g, i in rows], "source string, doc_id long, text string")
    got = text.following(docs, "source", "doc_id", "text", 4)
    plain = docs.withColumn("next", F.lead("text").over(Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"))))
    assert sorted(map(repr, (r[:] for r in got.select(plain.columns).collect()))) == sorted(map(repr, (r[:] for r in plain.collect())))
    windows = [x for x in plan(got).split("\n") if "lead(text" in x and "Window" in x]
    assert windows and all("[source#" in x and ", #block#" in x for x in windows) and "REPARTITION_BY_NUM" in plan(got)


def test_a_null_text_has_no_edit(spark):
    docs = spark.createDataFrame([("a", 1, "x y"), ("a", 2, None), ("a", 3, "x z"), ("a", 4, "x y z")], "source string, doc_id long, text string")
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert [tuple(r) for r in QUERIES["token_splice"](spark, at).collect()] == [(3, 1, 0, "y")]
