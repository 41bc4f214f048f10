import numpy as np
import pytest

from plumbline.llm import whitening
from plumbline.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """By whole numbers and numpy, over the different grid vectors."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], object)
    v = np.array([[float(sum(y[:, i] * y[:, j])) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    white = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x]) @ q / np.sqrt(e)
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], white, e / np.trace(v)


def matches(rows, ids, vectors):
    n, deviation, white, explained = brute(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * white.shape[1]
    for c in range(white.shape[1]):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(abs(mine - white[:, c]).max(), abs(mine + white[:, c]).max()) < 1e-7
        assert got[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert all(got[i, 1]["deviation"] == d and got[i, 1]["n"] == n for i, d in zip(ids, deviation))
    assert max(r["identity_error"] for r in rows) < 1e-8


def test_whole_table_equals_brute_force(spark):
    rows = op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    given = [r for r in given if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    matches(rows, [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_nulls_copies_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = [[float(c) for c in rng.normal(size=5).astype(np.float32)] for _ in range(40)]
    good = list(enumerate(vectors)) + [(100 + i, vectors[0]) for i in range(500)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, [-float("inf")] + [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA).selectExpr("*", "'a' x", "1 as n", "2 as component", "3 as k")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    matches(op13_embedding_whitening(spark, str(tmp_path)).collect(), [i for i, _ in good], [v for _, v in good])


def test_null_ids_and_short_vectors_stay(spark):
    rows = [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, [1.0], 0), (2, [0.0, 0.5], 0), (3, [], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted([(str(r[0]), c) for r in rows for c in (1, 2)])
    assert {r["n"] for r in got} == {4}


def test_no_direction_and_empty(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_a_flat_dimension_has_no_component(spark):
    rows = [(i, [float(i), 1.0, float(i * i % 7)], 0) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 5.0], 0), (4, [1e6, 6.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(np.isfinite(r["whitened"]) for r in got)
    by = {r["vec_id"]: r["deviation"] for r in got}
    assert by[1] is None and by[4] is not None
