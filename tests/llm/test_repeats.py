import hashlib
import random

from plumbline.llm import repeats
from plumbline.llm.queries import op7_repeats


def brute(rows):
    place = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w not in least or (place(i), s) < least[w]:
                least[w] = (place(i), s)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if least[raw[s : s + 100]] < (place(i), s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_real_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = [tuple(r) for r in op7_repeats(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def planted():
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [text(n) for n in (60, 99, 100, 101, 130, 400)]
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "a" * 5000), (6, "ab" * 700), (7, "x" * 150 + "y" + "x" * 150)]
    for i in range(10, 120):
        rows.append((i, text(rng.randint(0, 80)) + "".join(rng.choice(shared) + text(rng.randint(0, 5)) for _ in range(rng.randint(0, 4)))))
    rows += [(None, shared[5]), (500, shared[5]), (500, shared[5]), (501, "z" + shared[5]), (501, shared[5]), (10, rows[20][1])]
    return rows


def test_planted_rows(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame([(i, t, "q", 5) for i, t in rows], "doc_id long, text string, a string, at int").repartition(3)
    want = sorted(brute(rows), key=key)
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=key) == want
    monkeypatch.setattr(repeats, "HEAVY", 2)
    monkeypatch.setattr(repeats, "BROADCAST_SPANS", 0)
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=key) == want


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_several_parts(spark):
    """Texts are anchored in parts; repeats that lie across an edge of one count like any other."""
    rng = random.Random(7)
    filler = lambda n: rng.randbytes(n).translate(bytes(97 + b % 26 for b in range(256))).decode()
    shared = filler(300)
    edge = repeats.PART
    long = filler(edge - 130) + shared + filler(5000) + shared[20:250]
    rows = [(1, "x" + shared[:200]), (2, long), (3, shared[100:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=key) == sorted(brute(rows), key=key)


def test_different_texts_without_an_id(spark):
    """Thousands of texts under one id, with shared headers at one place: a clean one loses nothing for another."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    header, other = text(180), text(250)
    rows = []
    for k in range(5000):
        rows.append((None if k % 5 else 7, (header[: rng.randint(90, 180)] if k % 3 == 0 else "") + text(rng.randint(100, 160)) + (other if k % 17 == 0 else "")))
    rows += [(7, header + text(50)), (3, other), (3, "q" + other), (9, header + text(30)), (9, header + text(40)), (9, header[:150] + text(60)), (-5, header)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=key) == sorted(brute(rows), key=key)
