import math
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import classifier
from plumbline.llm.queries import op12_quality_classifier

LABELS = "doc_id long, quality int, toxic int"


def test_equals_a_plain_model_and_tells_held_out_documents_apart(spark):
    """All scores against the formulas with plain loops, and the accuracy on documents that taught nothing."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = {r["doc_id"]: classifier.statistics(r["text"]) for r in docs}
    groups = [np.array([x[i] for i in x if label.get(i) == k and not out(i)]) for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    n = [len(g) for g in groups]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    target = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled) + 1e-3)

    def density(v, k):
        c = 0.7 * own[k] + 0.3 * target
        z = v - groups[k].mean(axis=0)
        return -0.5 * z @ np.linalg.solve(c, z) - 0.5 * np.linalg.slogdet(c)[1] + math.log(n[k])

    got = {r["doc_id"]: r for r in op12_quality_classifier(spark, sf).collect()}
    assert set(got) == set(x)
    for i, v in x.items():
        v = np.array(v)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(min(700, density(v, 0) - density(v, 1)))), abs=1e-6)
        assert got[i]["held_out"] == out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    held = [(got[i]["predicted"], label[i]) for i in x if out(i) and i in label]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)


def made(n, seed=1):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["the", "river", "bends", "slowly", "under", "old", "bridges"]) + rng.choice(["", "", ","]) for _ in range(rng.randint(30, 200)))
    bad = lambda: " ".join(rng.choice(["buy", "now", "win"]) + rng.choice(["!!!", "$$$", "###"]) for _ in range(rng.randint(30, 200)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(n)]
    return rows, [(i, int(i % 4 != 0), 0) for i in range(n)]


def test_edges(spark, tmp_path):
    rows, labels = made(400)
    rows += [(1000, None), (1001, ""), (None, "a b"), (None, None), (5, rows[5][1]), (1002, "word " * 400_000)]
    labels += [(None, 1, 0), (7, None, 0), (8, 5, 0), (1, 1, 0), (99_999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as quality", "1 as x", "2 as score", "true as held_out")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).selectExpr("*", "'t' as text").write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0] == by[5][1] and by[1000][0]["score"] == by[1001][0]["score"]
    assert all(r["held_out"] for r in by[None])
    assert np.mean([by[i][0]["predicted"] == int(i % 4 != 0) for i in range(400)]) > 0.98


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows, labels = made(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    one, two = (sorted((r["doc_id"], round(r["score"], 9)) for r in classifier.score(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert one == two


def test_no_labels_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.limit(0), none).collect() == []
