"""Brute-force versions of what SQL does not express, and edge cases of the expressions."""

import itertools
import random

from pyspark.sql import functions as F

from plumbline.functions import masks, names, position
from plumbline.functions import symbols as grammar
from plumbline.operators import calls, lookup, search, text
from plumbline.plans.closure import closure
from plumbline.plans.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_packed_positions_sort_and_saturate(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(0, 1 << 21), rng.randrange(0, 1 << 13)) for _ in range(300)] + [(0, 0), ((1 << 20) - 1, 4095), (524288, 1)]
    df = spark.createDataFrame(pairs, "l int, c int").select("l", "c", position.pack("l", "c").alias("p"))
    for r in df.select("*", position.unpack_line("p").alias("a"), position.unpack_char("p").alias("b")).collect():
        assert (r["a"], r["b"]) == (min(r["l"], (1 << 20) - 1), min(r["c"], 4095)) and r["p"] >= 0


def slow_score(query, name):
    q = "".join(c for c in query if c.isalnum()).lower()
    marked, before = [], " "
    for c in name:
        if c.isalnum():
            marked.append((c.lower(), not before.isalnum() or c.isupper() and not before.isupper() or c.isdigit() and not before.isdigit()))
        before = c
    plain = "".join(c for c, _ in marked)
    if not q or not plain:
        return None
    if plain == q:
        return 1_000_000 - len(plain)
    if plain.startswith(q):
        return 100_000 - len(plain)
    hits = [sum(marked[i][1] for i in at) for at in itertools.combinations(range(len(plain)), len(q)) if all(plain[i] == c for i, c in zip(at, q))]
    return 1000 + 1000 * max(hits) - len(plain) if hits else None


def test_scores_equal_all_embeddings(spark):
    rng = random.Random(4)
    some = ["workspaceSymbol", "WSymbol2x", "foo_bar", "", "--", "aBcABc", "ab12cd34"] + ["".join(rng.choices("abAB1_", k=rng.randint(1, 10))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in some], "n string")
    for query in ("ab", "ws", "b1", "A_B", "x", "", "_"):
        got = {r["n"]: r["s"] for r in df.select("n", names.score(query, F.col("n")).alias("s")).collect()}
        assert got == {n: slow_score(query, n) for n in some}
    assert one(spark, names.initials(F.lit("workspaceSymbol2go x"))) == "ws2x"


def test_member_search():
    cases = {("", "any"): True, ("mE", "myExt"): True, ("my", "myExt"): True, ("yE", "myExt"): False, ("mEx", "myEqExt"): True, ("Ex", "EqExt"): True, ("E", "myExt"): True, ("abc", "ab"): False, ("aBd", "aBcBd"): True, ("aBd", "aBcd"): False}
    for (q, n), want in cases.items():
        assert names.matches_member(q, n) == want, (q, n)


def test_search_ranks_unscored_last(spark):
    rows = [(0, "alphaBeta", "Own", "pkg"), (1, "beta", "alpha", "pkg"), (2, "alpha", "x", "pkg"), (3, "zzz", "alp", "pkg"), (4, "AnyLongParser", "x", "y")]
    df = spark.createDataFrame(rows, "symbol_ord long, display string, owner string, package_name string")
    got = [(r["symbol_ord"], r["score"]) for r in search.search(df, "alp").collect()]
    assert [k for k, _ in got] == [2, 0, 4, 1, 3] and got[-1][1] is None
    assert search.search(df, "").count() == 0 and search.search(df, "alpha", 0).count() == 0
    assert [r["symbol_ord"] for r in search.search(df, "alpha pkg").collect()] == [0, 1, 2]


def test_symbol_grammar(spark):
    cases = {
        "a/b/C#m(+1).": ("a/b/C#", "method", "m", "(+1)"),
        "a/`x y`.": ("a/", "term", "x y", None),
        "a/": ("", "package", "a", None),
        "a/C#m().(p)": ("a/C#m().", "parameter", "p", None),
        "a/C#[T]": ("a/C#", "type_parameter", "T", None),
        "a/C#": ("a/", "type", "C", None),
    }
    df = spark.createDataFrame([(s,) for s in [*cases, "local3", "", "a/C"]], "s string")
    got = {r["s"]: r["x"] for r in df.select("s", grammar.split_last(F.col("s")).alias("x")).collect()}
    assert {s: tuple(x) for s, x in got.items() if x} == cases and not any(got[s] for s in ("local3", "", "a/C"))
    assert one(spark, grammar.owner_chain(F.lit("a/b/C#m(+1)."))) == ["a/", "a/b/", "a/b/C#", "a/b/C#m(+1)."]
    assert one(spark, grammar.owner_chain(F.lit("local1"))) == []
    assert one(spark, grammar.companion(F.lit("a/C#"))) == "a/C." and one(spark, grammar.companion(F.lit("a/C.m()."))) is None
    assert one(spark, grammar.package_name(F.lit("a/b/C#"))) == "a.b"
    assert one(spark, grammar.rename_token(F.lit("type"))) == "`type`" and one(spark, grammar.rename_token(F.lit("a`b"))) is None
    assert one(spark, grammar.local_key(F.lit("local0"), F.lit(42))) == "local0@42"


def test_masks(spark):
    assert one(spark, masks.explain(F.lit(5))) == ["symbol is defined outside the workspace", "symbol has occurrences in readonly sources"]
    assert one(spark, masks.severity(F.lit(9))) == 3
    assert one(spark, masks.freshness(F.lit("x"), F.lit("9dd4e461268c8034f5c8564e155c67a6"))) == "Fresh"
    assert one(spark, masks.freshness(F.lit("x"), F.lit(None).cast("string"))) == "MissingMd5"


def test_closure_both_ways_agree_on_cycles(spark):
    rng = random.Random(7)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "n int")
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(3, 3)], "a int, b int")
    near = sorted(map(tuple, closure(nodes, edges).collect()))
    assert near == sorted(map(tuple, closure(nodes, edges, local=0).collect()))


def test_components_of_paths_stars_and_self_edges(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(200, 200), (301, 300), (300, 301)] + [(None, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 300: 300, 301: 300}


def test_symbol_at_over_long_spans(spark):
    rng = random.Random(9)
    rows = [((k,), 1, k, s := rng.randrange(0, 1 << 21), s + rng.choice([0, 5, 5000, 1 << 20])) for k in range(300)]
    occ = spark.createDataFrame(rows, "seq struct<k:long>, doc_ord long, symbol_ord long, ps long, pe long")
    at = [rng.randrange(0, 1 << 22) for _ in range(200)]
    got = {r["at"]: r["symbol_ord"] for r in lookup.symbol_at(occ, spark.createDataFrame([(1, a) for a in at], "doc_ord long, at long")).collect()}
    want = {a: min((e - s, s, k) for (k,), _, _, s, e in rows if s <= a <= e)[2] for a in at if any(s <= a <= e for _, _, _, s, e in rows)}
    assert got == want


def test_successors_skip_what_lies_inside(spark):
    rng = random.Random(11)
    rows = []
    for doc in range(20):
        chains = [["r"]]
        for k in range(rng.randint(1, 25)):
            chains.append([*rng.choice(chains)[:3], f"s{k}"])
        rows += [(doc, i, c[-1], c) for i, c in enumerate(chains)]
    df = spark.createDataFrame(rows, "doc int, start int, symbol string, owners array<string>")
    got = {(r["doc"], r["symbol"]): r["next"] for r in calls.successors(df).collect()}
    want = {(d, s): min((t for e, t, _, c in rows if e == d and t > i and s not in c), default=None) for d, i, s, _ in rows}
    assert got == want


def test_splices_rebuild_the_second_list(spark):
    rng = random.Random(13)
    rows = [(i, rng.choices("ab", k=rng.randint(0, 8)), rng.choices("ab", k=rng.randint(0, 8))) for i in range(200)]
    got = {r["doc_id"]: r for r in text.splice(spark.createDataFrame(rows, "doc_id int, a array<string>, b array<string>")).collect()}
    for i, a, b in rows:
        if a == b:
            assert i not in got
        else:
            r = got[i]
            assert a[: r["start"]] + r["added"].split() + a[r["start"] + r["removed"] :] == b


def test_regions_equal_a_stack(spark):
    rng = random.Random(15)
    rows = [(c, t, rng.choice([1, -1])) for c in range(40) for t in range(rng.randint(0, 15))]
    want, stack = [], {}
    for c, t, s in rows:
        if s == 1:
            stack.setdefault(c, []).append(t)
        elif stack.get(c):
            want.append((c, stack[c].pop(), t))
    got = text.region_pairs(spark.createDataFrame(rows, "conv_id int, turn int, step int")).select("conv_id", "open_turn", "close_turn").collect()
    assert sorted(map(tuple, got)) == sorted(want)
