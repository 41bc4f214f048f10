import math
import random
import zlib
from collections import Counter

import numpy as np

from plumbline.llm import suffixtree
from plumbline.llm.queries import op4_lm_scores


def base(rows):
    toks = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c, ends = Counter(), 0
    for k, ws in toks.items():
        if not out[k]:
            c.update(ws)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    res = []
    for k, ws in toks.items():
        s = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in ws), ends])
        res.append((rows[k][0], out[k], len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, s))
    return res


def order(r):
    return tuple((x is None, round(x, 6) if isinstance(x, float) else x) for x in r)


def test_base_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "FREQUENT", 500)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op4_lm_scores(spark, "/root/testdata/sf0.01").collect()
    assert sorted((order(r[:6]) for r in got)) == sorted(map(order, base(rows)))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "A b"), (3, "a B a"), (3, "a B a"), (4, "x" * 100_000), (5, "é ñ " * 50)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, row int, word string")
    got = suffixtree.score(df).collect()
    assert sorted(order(r[:6]) for r in got) == sorted(map(order, base(rows)))
    assert suffixtree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_context_is_cut_and_parts_change_no_score(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    want = sorted(map(tuple, suffixtree.score(docs).collect()))
    monkeypatch.setattr(suffixtree, "CONTEXTS", 100, raising=False)  # a bound that there was
    monkeypatch.setattr(suffixtree, "PART", 1000, raising=False)
    monkeypatch.setattr(suffixtree, "HELD", 1, raising=False)
    got = sorted(map(tuple, suffixtree.score(docs).collect()))
    assert len(got) == len(want) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(got, want))


def test_cuts_hold_every_pair_once():
    assert suffixtree.cuts({}, 5) == [0, 1 << 16]
    assert suffixtree.cuts({7: 3, 9: 3, 300: 9, 301: 1, 302: 4}, 5) == [0, 9, 300, 301, 1 << 16]


def test_tree_gives_a_distribution_and_longest_suffixes():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["abra", "cad", "ab", "a"], k=20)).encode() for _ in range(50)]
    grams, _ = suffixtree.packed(texts, 3)
    counts = [Counter((g & suffixtree.mask(d + 1) for g in grams.tolist())) for d in range(4)]
    root = np.ones(256)
    for g, c in counts[0].items():
        root[g] += c
    contexts, symbols = [], []
    for d in range(1, 4):
        total, kinds = Counter(), Counter()
        for g, c in counts[d].items():
            total[g >> 8] += c
            kinds[g >> 8] += 1
        keep = sorted(x for x in total if rng.random() < 0.6)
        contexts.append((np.array(keep, np.uint64), np.array([total[x] for x in keep], float), np.array([kinds[x] for x in keep], float)))
        own = [(g, c) for g, c in counts[d].items() if g >> 8 in set(keep)]
        symbols.append((np.array([g for g, _ in own], np.uint64), np.array([c for _, c in own], float)))
    tree = suffixtree.Tree.build(3, np.log10(root / root.sum()), contexts, symbols)

    def slow(ctx, s, d):
        if d == 0:
            return root[s] / root.sum()
        low = slow(ctx, s, d - 1)
        part = ctx & suffixtree.mask(d)
        at = np.flatnonzero(contexts[d - 1][0] == part)
        if not len(at):
            return low
        n, k = contexts[d - 1][1][at[0]], contexts[d - 1][2][at[0]]
        return (counts[d].get(part << 8 | s, 0) + k * low) / (n + k)

    for ctx in random.Random(2).sample([g >> 8 for g in grams.tolist()], 20) + [0, 1 << 20]:
        asked = np.array([ctx << 8 | s for s in range(256)], np.uint64)
        p = 10 ** tree.score(asked)
        assert abs(p.sum() - 1) < 1e-9
        assert np.allclose(p, [slow(ctx, s, 3) for s in range(256)])


def brute_scores(rows):
    """The whole model by dictionaries: every context of up to DEPTH bytes, retained by the two tests, and the longest retained suffix for each byte."""
    depth = suffixtree.DEPTH
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    closed = [b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n" for _, t in rows]
    counts = [{} for _ in range(depth + 1)]
    for held, text in zip(out, closed):
        if not held:
            padded = b"\n" * depth + text
            for i in range(depth, len(padded)):
                for d in range(depth + 1):
                    counts[d].setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    kept = [{} for _ in range(depth + 1)]
    for d in range(1, depth + 1):
        for ctx, seen in counts[d].items():
            n, above = seen.total(), counts[d - 1][ctx[1:]]
            gain = sum(c * math.log(c / n * above.total() / above[x]) for x, c in seen.items())
            if n >= suffixtree.SEEN and gain >= suffixtree.DIVERGENCE:
                kept[d][ctx] = seen
    root = counts[0].get(b"", Counter())

    def p(ctx, x):
        for d in range(len(ctx), 0, -1):
            if ctx[-d:] in kept[d]:
                seen = kept[d][ctx[-d:]]
                return (seen[x] + len(seen) * p(ctx[-d + 1 :] if d > 1 else b"", x)) / (seen.total() + len(seen))
        return (root[x] + 1) / (root.total() + 256)

    words = Counter(w for held, (_, t) in zip(out, rows) if not held for w in (t or "").encode().lower().split())
    ends = sum(not h for h in out)
    whole = words.total() + ends + 0.5 * (len(words) + (ends > 0) + 1)
    found = []
    for (i, t), text in zip(rows, closed):
        tokens = [*((w + b" ", words[w]) for w in (t or "").encode().lower().split()), (b"\n", ends)]
        padded, at, score = b"\n" * depth + text, depth, 0.0
        for token, c in tokens:
            tree = 0.0
            for x in token:
                tree += math.log10(p(padded[at - depth : at], x))
                at += 1
            score += math.log10((1 - suffixtree.SHARE) * (c + 0.5) / whole + suffixtree.SHARE * 10**tree)
        found.append((i, score))
    return found


def test_scores_equal_the_model_by_dictionaries(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["abra", "cad", "The", "x1", "ñu", "abracadabra"] + [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(60)] + [(60, None), (None, "abra cad the zzz"), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), round(s, 6)) for i, s in brute_scores(rows))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in suffixtree.score(df).collect()) == want
    monkeypatch.setattr(suffixtree, "FREQUENT", 7)  # what is broadcast does not matter
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in suffixtree.score(df).collect()) == want
