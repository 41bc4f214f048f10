import random

import pyarrow as pa
import pytest

from plumbline.operators import references, selection


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_brute_force(spark, seed):
    """Nested, equal, crossing and touching spans, empty ones, and cursors outside all."""
    rng = random.Random(seed)
    spans = [(d, s, s + rng.choice([0, 1, 3, 10, 40])) for d in range(4) for s in [rng.randint(0, 60) for _ in range(40)]] + [(1, 0, 200), (1, 0, 200), (2, 9, 3), (None, 1, 2)]
    cursors = [(d, at) for d in range(5) for at in range(-1, 110, 3)] * 2 + [(None, 1)]
    a, b = spark.createDataFrame(spans, "doc int, start int, end int"), spark.createDataFrame(cursors, "doc int, at int")
    got = {(r["doc"], r["at"]): [tuple(x) for x in r["chain"]] for r in selection.chains(a.repartition(3), b).collect()}
    want = {}
    for d, at in set(cursors) - {(None, 1)}:
        out = []
        for s, e in sorted({(s, e) for x, s, e in spans if x == d and s <= at <= e}, key=lambda x: (x[1] - x[0], x[0])):
            if not out or s <= out[-1][0] and e >= out[-1][1]:
                out.append((s, e))
        want[d, at] = out or [(at, at)]
    assert got == want


def test_a_group_of_many_symbols_has_each_place_once(spark):
    """Rows are linear in postings; two symbols of a group share an answer where one target defines both."""
    n = 60
    groups = spark.createDataFrame([(k, 0) for k in range(n)], "symbol_ord int, component int")
    postings = spark.createDataFrame([(k, f"u{k % 7}", k * 10 + j, k * 10 + j + 3, j == 0, k % 3) for k in range(n) for j in range(4)], "symbol_ord int, uri string, ps long, pe long, is_def boolean, target_ord int")
    defs = spark.createDataFrame([(k, k) for k in range(n)], "symbol_ord int, def_doc int")
    docs = spark.createDataFrame([(k, k % 3) for k in range(n)], "doc_ord int, target_ord int")
    closure = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 0)], "source int, reached int")
    found = references.places(groups, postings)
    assert found.count() == 4 * n
    viewer = references.viewers(groups, defs, docs)
    assert references.answers(found, viewer, closure).count() == 4 * (40 + 20 + 20)
    cursors = spark.createDataFrame([(1, True), (5, False)], "symbol_ord int, needs_reindex boolean")
    got = references.of_groups(cursors, groups, postings, defs, docs, closure).collect()
    assert {r["symbol_ord"]: r["needs_reindex"] for r in got} == {1: True, 5: False}
    assert len([r for r in got if r["symbol_ord"] == 1]) == 80 and len([r for r in got if r["symbol_ord"] == 5]) == 80
    assert sorted(r["rank"] for r in got if r["symbol_ord"] == 5) == list(range(1, 81))


def test_the_spans_of_a_group_are_dealt_to_all_tasks(spark):
    """One group has most symbols: its spans are in no single task, and nothing is sorted or buffered for the rows that grow with its square."""
    groups = spark.createDataFrame([(k, 0) for k in range(40)] + [(90, 9)], "symbol_ord int, component int")
    overlay = spark.createDataFrame([(k, f"u{j}", j, j + k % 3) for k in range(40) for j in range(10)] + [(90, "v", 1, 2)], "symbol_ord int, uri string, ps long, pe long")
    got = references.fan_out(spark.createDataFrame([(1,), (2,), (1,), (90,), (91,)], "symbol_ord int"), groups, overlay)
    rows = [tuple(r) for r in got.select("symbol_ord", "ps", "pe", "uri", "hits").collect()]
    assert sorted(rows) == sorted([(s, j, j + k, f"u{j}", 30) for s in (1, 2) for j in range(10) for k in range(3)] + [(90, 1, 2, "v", 1)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_spans_that_cross_and_then_part_are_still_told_apart(spark):
    """After a crossing the chain is worked out in full, and shortly again where spans only nest; an empty row of spans is the place itself."""
    spans = [(1, 0, 9), (1, 2, 5), (1, 4, 8), (1, 20, 30), (1, 22, 30), (1, 22, 24), (2, 5, 5)]
    cursors = [(1, at) for at in (0, 3, 4, 5, 6, 9, 15, 20, 22, 25, 30)] + [(2, 5), (3, 1)]
    own = spark.createDataFrame(spans, "doc int, start int, end int")
    got = {(r["doc"], r["at"]): [tuple(x) for x in r["chain"]] for r in selection.chains(own, spark.createDataFrame(cursors, "doc int, at int")).collect()}
    assert got == {(d, at): selection.chain_of([(s, e) for x, s, e in spans if x == d and s <= at], at) for d, at in cursors}
    # Chains of one batch go out as flat columns, without a row for each.
    batch = pa.RecordBatch.from_pydict({"doc": [1, 1, 1], "start": [0, 1, 2], "end": [9, 4, 2], "cursor": [False, False, True]})
    (out,) = selection._sweep(iter([batch]))
    assert out.column("chain").to_pylist() == [[{"start": 1, "end": 4}, {"start": 0, "end": 9}]]
