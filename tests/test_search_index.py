import itertools
import random
import re

import pytest

from pyspark.sql import functions as F

from plumbline.functions.names import matches_member
from plumbline.operators import search_index as index


def tokens(s):
    return [t.lower() for t in re.findall(r"[^\W_]+", s or "")]


def humps(name):
    out, before = [], " "
    for c in name:
        if c.isalnum():
            out.append((c.lower(), not before.isalnum() or c.isupper() and not before.isupper() or c.isnumeric() and not before.isnumeric()))
        before = c
    return out


def hits(query, name):
    best = {0: 0}
    for c, hump in humps(name):
        for j in sorted(best, reverse=True):
            if j < len(query) and query[j] == c:
                best[j + 1] = max(best.get(j + 1, -1), best[j] + hump)
    return best.get(len(query))


def score(query, name):
    wanted, plain = "".join(tokens(query)), "".join(tokens(name))
    if not wanted or not plain:
        return None
    if wanted == plain:
        return 1_000_000 - len(plain)
    if plain.startswith(wanted):
        return 100_000 - len(plain)
    n = hits(wanted, name)
    return None if n is None else 1000 + 1000 * n - len(plain)


def brute(rows, query, limit, cap):
    asked = tokens(query)
    if not asked:
        return []
    found = {o: score(query, d or "") for o, d, w, p in rows if all(any(t.startswith(q) for t in tokens(d) + tokens(w) + tokens(p)) for q in asked)}
    if len(asked) == 1:
        plain = sorted(("".join(tokens(d)), o) for o, d, _, _ in rows)
        short = sorted(("".join(c for c, h in humps(d or "") if h), o) for o, d, _, _ in rows)
        near = []
        for k, o in plain + short:
            if k.startswith(asked[0][0]) and o not in near and len(near) < cap:
                near.append(o)
        for o in near:
            s = score(query, next(d for i, d, _, _ in rows if i == o) or "")
            if o not in found and s is not None:
                found[o] = s
    best = sorted(found.items(), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:limit]
    return [(query, k, o, s) for k, (o, s) in enumerate(best, 1)]


@pytest.mark.parametrize("limit, cap", [(7, 5000), (200, 9), (1500, 4)])
def test_batches_equal_the_rules_one_by_one(spark, limit, cap):
    rng = random.Random(limit)
    parts = ["open", "Buffer", "map", "Fact", "of", "XML", "id", "é", "9", "_", "workspaceSymbol", "a"]
    name = lambda: "".join(rng.choices(parts, k=rng.randint(0, 4)))
    rows = [(i, rng.choice([name(), name(), None, name() + " " + name()]), rng.choice([None, "", name()]), "pkg." + name()) for i in range(160)]
    queries = [name() + rng.choice(["", " ", "."]) + name() for _ in range(40)] + ["o", "ob", "oB", "pkg", "pkg open", "open open", "", "..", None, "zz", "zz open", "workspaces", "b" * 40, "é"] + [r[1] for r in rows[:30]]
    found = index.build(spark.createDataFrame(rows, "symbol_ord int, display string, owner string, package_name string").repartition(5), cap=cap)
    got = index.search_batch(found, spark.createDataFrame([(q,) for q in queries], "query string").repartition(3), limit).collect()
    want = [x for q in {q for q in queries if q is not None} for x in brute(rows, q, limit, cap)]
    assert sorted((r["query"], r["rank"], r["symbol_ord"], r["score"]) for r in got) == sorted(want)


def test_each_task_keeps_the_limit(spark):
    """The plan drops what cannot rank before the shuffle, and no window is without a key."""
    rows = spark.range(1000).selectExpr("cast(id as int) symbol_ord", "concat('name', id) display", "'' owner", "'' package_name")
    found = index.search_batch(index.build(rows), spark.createDataFrame([("na",), ("name1",)], "query string"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "SinglePartition" not in plan
    assert found.count() == 40


def test_members_equal_the_loop(spark):
    rng = random.Random(5)
    alphabet = "abAB1_é"
    names = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(400)] + ["fooBarBaz", "FooBar", "日本Ab", "a\nB", "AbxAbCd", r"\E.*", None]
    queries = ["".join(t) for n in range(4) for t in itertools.product("abA1", repeat=n)] + ["fBB", "FB", "AbC", "日A", "a\nB", "_", "é", r"\E", ".", "B1a", None]
    df = spark.createDataFrame(list(enumerate(names)), "symbol_ord int, name string")
    got = sorted(map(tuple, index.member_batch(df, spark.createDataFrame([(q,) for q in queries], "query string")).collect()))
    want = sorted((q, i) for q in queries if q is not None for i, n in enumerate(names) if n is not None and matches_member(q, n))
    assert got == want


def test_empty(spark):
    rows = spark.createDataFrame([], "symbol_ord int, display string, owner string, package_name string")
    assert index.search_batch(index.build(rows), spark.createDataFrame([("a",)], "query string")).collect() == []


def test_the_keys_of_names_are_never_broadcast(spark):
    """By the size of the files they would be, with a row for each bucket and capital of every name."""
    names = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_partkey").alias("symbol_ord"), F.initcap("p_name").alias("name"))
    asked = spark.createDataFrame([("Bl",)], "query string")
    tree = index.member_batch(names, asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in tree and "BuildRight" in tree and "BuildLeft" not in tree
