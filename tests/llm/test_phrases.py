import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import phrases
from plumbline.llm.queries import OP11_SQL, op11_phrases
from tests.llm.oracle import compare


def brute(rows, least, top, longest=5):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = set()
    for g, a in found.items():
        for i in range(1, len(g)):
            for j in range(i + 2, len(g) + 1):
                if (i, j) != (1, len(g)) and a >= f[g[0], *g[i:j]]:
                    inside.add((g[0], *g[i:j]))
    out = []
    for lang in n:
        rest = []
        for g, a in found.items():
            if g[0] == lang and g not in inside:
                cuts = [(1000 * a * n[lang] // (f[g[:k]] * f[lang, *g[k:]]), k, f[g[:k]], f[lang, *g[k:]]) for k in range(2, len(g))]
                score, _, left, right = min(cuts)
                rest.append((-score, -a, " ".join(g[1:]).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, rows):
    rng = random.Random(seed)
    words = ["a", "B", "c", "de", "é", "日本", "x-y", "😀"]
    out = []
    for _ in range(rows):
        w = rng.choices(words, [8, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 60))
        out.append((rng.choice(["en", "en", None, "", "de"]), "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! "]) for x in w)))
    return out


@pytest.mark.parametrize("shard", [7, 64, 1 << 20])
def test_equals_brute_force(spark, shard):
    rows = texts(shard, 300) + [("en", None), (None, None), ("de", ""), ("de", "zz " * 500), ("en", "p q p q " * 90)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as c", "3 as w", "4 as score").repartition(5)
    for least, top in ((1, 10_000), (9, 25), (40, 3)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top, shard=shard).collect())
        assert got == brute(rows, least, top)


def test_matches_sql(spark):
    compare(spark, op11_phrases, OP11_SQL, "/root/testdata/sf0.01")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_phrases(spark, str(tmp_path)).collect() == []


def test_products_beyond_64_bits(spark):
    """Counts as a corpus of 100 TB may have them, through the same expressions."""
    a, n, left, right = 123_456_789_012, 9_999_999_999_937, 987_654_321_987, 123_456_789_555
    counts = [("en", "p q", a), ("en", "p", left), ("en", "q", right), ("en", "", n)]
    df = spark.createDataFrame(counts, "lang string, phrase string, c long")
    saved = phrases.phrase_counts
    try:
        phrases.phrase_counts = lambda *_, **__: df
        row = phrases.collocations(spark.range(0)).first()
    finally:
        phrases.phrase_counts = saved
    assert row["score"] == 1000 * a * n // (left * right)


def test_intervals_of_a_shard():
    rng = np.random.default_rng(3)
    for _ in range(20):
        ids = rng.integers(0, 4, rng.integers(1, 80))
        starts = int(rng.integers(1, len(ids) + 1))
        want = Counter(tuple(ids[i : i + k]) for k in range(1, 6) for i in range(starts) if i + k <= len(ids) and 0 not in ids[i : i + k])
        got = {tuple(ids[p : p + k]): c for k, places, counts in phrases.intervals(ids.astype(np.int64), starts, 1, 5) for p, c in zip(places, counts)}
        assert got == want


def test_bitmaps_only_let_more_through(spark):
    rows = texts(5, 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=10, top=500, bits=(6, 6)).collect()) == brute(rows, 10, 500)
