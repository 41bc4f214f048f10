import random

import pytest

from plumbline.operators import lookup
from plumbline.plans.closure import closure, condensed, doubled


def brute(nodes, edges):
    follow = {}
    for a, b in edges:
        follow.setdefault(a, set()).add(b)
    out = set()
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            for x in follow.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out |= {(s, x) for x in seen}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_equal_brute_force(spark, seed):
    """Cycles, self edges, repeated edges, ends that are no nodes; on the driver, by doubling, and beyond the spans."""
    rng = random.Random(seed)
    n, m = [(30, 20), (60, 90), (60, 400), (200, 230)][seed]
    nodes = [f"n{k}" for k in range(n)]
    edges = [(f"n{rng.randrange(n + 5)}", f"n{rng.randrange(n + 5)}") for _ in range(m)] * 2 + [(None, "n1"), ("n1", None)]
    a, b = spark.createDataFrame([(x,) for x in nodes + nodes[:3] + [None]], "id string"), spark.createDataFrame(edges, "f string, t string")
    want = brute(nodes, [e for e in edges if None not in e])
    assert {tuple(r) for r in closure(a, b).collect()} == want
    assert {tuple(r) for r in closure(a, b, local=0).collect()} == want
    assert seed == 2 or condensed(a, b, most=3) is None
    found = condensed(a, b)
    asked = [(x, y) for x in nodes[:20] for y in nodes]
    assert {tuple(r) for r in found.sees(spark.createDataFrame(asked, "x string, y string"), "x", "y").collect()} == want & set(asked)


def test_a_long_chain_and_a_large_cycle(spark):
    """What is kept grows with the nodes; pairs are made for what is asked."""
    n = 100_000
    chain = condensed(spark.range(n), spark.range(n - 1).selectExpr("id", "id + 1"))
    assert chain.spans.count() == n and chain.members.count() == n
    assert chain.pairs(spark.createDataFrame([(0,), (n - 10,), (n + 7,)], "id long")).count() == n + 10
    asked = spark.createDataFrame([(5, 99_999), (99_999, 5), (7, 7), (3, n + 1)], "x long, y long")
    assert sorted(map(tuple, chain.sees(asked, "x", "y").collect())) == [(5, 99_999), (7, 7)]
    ring = condensed(spark.range(10_000), spark.range(10_000).selectExpr("id", "(id + 1) % 10000"))
    assert ring.spans.count() == 1 and ring.pairs(spark.createDataFrame([(1,), (2,)], "id long")).count() == 20_000


def test_doubling_takes_few_rounds(spark, monkeypatch):
    from plumbline.plans import closure as module

    saved = []
    save = module.Scratch.save
    monkeypatch.setattr(module.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    assert doubled(spark.range(200), spark.range(199).selectExpr("id", "id + 1")).count() == 200 * 201 // 2
    assert len([x for x in saved if x.startswith("reached")]) <= 9


def test_symbols_of_unknown_targets_are_seen_by_all(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "source int, reached int")
    defs = spark.createDataFrame([(10, 100), (11, 101), (12, 102)], "symbol_ord int, def_doc int")
    docs = spark.createDataFrame([(100, 1), (101, 77)], "doc_ord int, target_ord int")
    got = sorted(map(tuple, lookup.allowed_targets(defs, docs, pairs).collect()))
    assert got == [(10, 1), (10, 2), (11, 1), (11, 2), (12, 1), (12, 2)]
    assert lookup.allowed_targets(defs, docs, pairs.limit(0)).count() == 0


def test_an_empty_graph(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert closure(none.select("a"), none).count() == 0
    assert closure(spark.createDataFrame([(1,)], "a int"), none).collect() == [(1, 1)]
