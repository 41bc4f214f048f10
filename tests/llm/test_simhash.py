import random

import numpy as np
import xxhash

from plumbline.llm import simhash
from plumbline.llm.queries import op8_simhash


def brute(rows):
    fps = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 4:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return {i: (f"{fps[i]:016x}", top(i)) for i in ids}


def test_every_near_pair_meets_at_an_anchor():
    rng = random.Random(5)
    for threshold, blocks in ((4, 3), (4, 2), (3, 2), (4, 4)):
        plan = simhash.layout(threshold, blocks)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, threshold)):
                y ^= 1 << b
            met = False
            for shift, bits, t in plan:
                u, v = np.array([x >> shift & (1 << bits) - 1], np.uint64), np.array([y >> shift & (1 << bits) - 1], np.uint64)
                go = lambda p: p ^ (simhash.steps(bits, 1 + t)[int(simhash.syndromes(p)[0])] if t else simhash.steps(bits, 1)[int(simhash.syndromes(p)[0])][:1])
                met |= bool(np.isin(go(u)[:1], go(v)).any())
            assert met


def test_large_buckets_keep_every_connection():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for b in base]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        after = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (after == label).all():
            break
        label = after
    a, b = simhash.reached(prints, 4)
    u, v = simhash.forest(a, b)
    got = np.arange(len(prints))
    got[u] = v
    assert (got == label).all() and near[a, b].all()


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, " \t\n")]
    for i in range(5, 150):
        if i % 3 == 0:
            t = rows[rng.randrange(5, i)][1].split() if i > 6 else ["a"]
            t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.choice([3, 4, 60, 200])))))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, rep long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_simhash(spark, str(tmp_path)).count() == 0


def test_very_long_texts_null_ids_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(simhash._FLUSH + 4000))
    rows = [(1, long), (2, long.upper()), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (5, "")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")).collect()
    want = brute([(i, t) for i, t in rows if i is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) == want[r["doc_id"]]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["3", "None"]


def test_stage_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert simhash.deduplicate(empty).count() == 0 and simhash.deduplicate(empty).columns == empty.columns
