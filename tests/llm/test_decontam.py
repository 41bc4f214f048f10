import random
from collections import Counter

import numpy as np

from plumbline.llm.decontam import BLOCKS, RADIUS, _block_edges, decontaminate, lookup, matches
from plumbline.llm.queries import OP10_SQL, op10_decontamination
from tests.llm.oracle import compare


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, t in items:
            q = (t or "").lower().split()
            if not q or len(w) < min(5, len(q)):
                continue
            k = min(5, len(q))
            own = grams(q, k)
            last = max(0, len(w) - len(q))
            for s in sorted({min(p, last) for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in own}):
                win = grams(w[s : s + len(q)], k)
                sim = (own & win).total() / (own | win).total()
                if sim >= 0.8 - 1e-12 and (d, i) not in out or sim > out.get((d, i), (9, 9))[0]:
                    out[(d, i)] = (sim, s)
    return out


def test_blocks_guarantee_the_radius():
    edges = _block_edges()
    assert len(edges) == BLOCKS == RADIUS + 1 and edges[0][0] == 0 and edges[-1][1] == 64 and all(a < b for a, b in edges)


def test_real_rows_match_sql(spark):
    compare(spark, op10_decontamination, OP10_SQL, "/root/testdata/sf0.01")


def test_planted_rows_match_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 3, 5, 12, 40, 60, 60])] + [(90, None), (91, " "), (92, "AA bb CC dd EE aa bb cc dd ee")]
    docs = [(0, None), (1, ""), (2, "v1"), (3, "aa BB cc dd ee Aa bb cc dd ee aa bb cc dd ee")]
    for i in range(10, 160):
        q = rng.choice(items[:7])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(q))
            q[at : at + rng.choice([0, 1])] = [rng.choice(vocab)]
        pad = lambda: rng.choices(vocab, k=rng.choice([0, 3, 30]))
        docs.append((i, " ".join([*pad(), *q, *pad(), *(q if i % 5 == 0 else [])])))
    docs += [docs[-1], (None, items[4][1])]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, pos int, item_id string")
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in matches(df, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    kept = [r["doc_id"] for r in decontaminate(df, bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if not any(d == i for d, _ in want))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert matches(docs, bench).count() == 0 and matches(one, bench).count() == 0
    assert matches(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_radius_loses_nothing_of_the_least_similar():
    """Fingerprints of 40,000 pairs of shingle sets with the least similarity that matches, none of them further apart than the radius."""
    rng, worst = np.random.default_rng(5), 0
    for shingles in (9, 18, 45, 90):
        part = lambda n: rng.integers(0, 2, (2_500, 64, n), dtype=np.int8).sum(axis=2, dtype=np.int32)
        for _ in range(4):
            common = part(8 * shingles // 9)
            a, b = common + part(shingles // 9), common + part(shingles // 9)
            worst = max(worst, int(((2 * a > shingles) != (2 * b > shingles)).sum(axis=1).max()))
    assert 12 < worst <= RADIUS


def test_index_gives_every_print_within_the_radius(spark):
    rng = random.Random(2)
    items = [(n, i, rng.getrandbits(63)) for i in range(60) for n in (20, 30)]
    asked = []
    for n, _, fp in items:
        for far in (0, 5, 24, 25):
            flips = sum(1 << b for b in rng.sample(range(63), far))
            asked.append((n, fp ^ flips))
    want = {(n, f, i) for n, f in asked for m, i, g in items if n == m and (f ^ g).bit_count() <= RADIUS}
    got = lookup(spark.createDataFrame(asked, "n int, fp long").distinct(), spark.createDataFrame(items, "n int, item_id long, item_fp long")).collect()
    assert len(got) == len(want) and {(r["n"], r["fp"], r["item_id"]) for r in got} == want


def test_long_text_and_shingles_that_many_items_share(spark):
    shared = "all of these words are in every item here"
    items = [(i, f"{shared} " + " ".join(f"i{i}w{k}" for k in range(40))) for i in range(30)]
    docs = [(1, "pad " * 30_000 + items[7][1] + " pad" * 30_000), (2, f"{shared} " * 500), (3, items[3][1].upper())]
    got = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in got} == {(1, 7, 30_000), (3, 3, 0)}


def test_stage_on_empty_tables(spark):
    empty, items = spark.createDataFrame([], "doc_id long, text string, n int"), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g", 2)], "doc_id long, text string, n int")
    assert decontaminate(empty, items).count() == 0 and decontaminate(empty, items).columns == empty.columns
    assert decontaminate(one, items.limit(0)).count() == 1 and decontaminate(one, items).count() == 0
