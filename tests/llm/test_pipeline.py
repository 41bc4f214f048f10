import random

import corpus_pipeline
from plumbline.llm import pieces
from plumbline.llm.quality import measure
from tests.llm.test_decontam import brute as brute_items
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute as brute_groups


def good(text):
    n, _, _, _, repeat, soft = measure(text)
    return n >= 50 and 100 * repeat <= 50 * n and soft <= 1


def masked(text, spans):
    """spans: kind:start:end by start, joined by commas."""
    out, at, end = [], 0, -1
    for k, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= end:
            out += [text[at:s], f"<{k}>"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def expected(rows, items):
    rows = [(i, t) for i, t in rows if good(t)]
    group = brute_groups(rows)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    hit = {d for d, _ in brute_items(rows, items)}
    rows = [(i, t) for i, t in rows if i not in hit]
    spans = brute_spans(rows)
    return {i: masked(t, spans[i, t]) for i, t in rows}


def run(spark, path):
    got = corpus_pipeline.run(spark, path).collect()
    m = pieces.model(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    assert all(r["decoded"] and r["n_pieces"] == len(r["ids"]) for r in got)
    return {r["doc_id"]: pieces.decode(r["ids"], m) for r in got}, len(got)


def test_real_rows(spark):
    path = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got, n = run(spark, path)
    want = expected(rows, items)
    assert n == len(got) and got == want


def test_stages_keep_columns_and_handle_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    text = lambda: " ".join(rng.choices(words, k=80))
    rows = [(0, None), (1, ""), (2, text()), (3, text()), (4, text() + " a.b@c.de " + text())]
    rows += [rows[2], (5, rows[2][1]), (None, text()), (6, "short")]
    df = spark.createDataFrame([(i, t, "en", None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(rows[3][1].split()[5:40])), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
    got, n = run(spark, str(tmp_path))
    assert n == 3 and set(got) == {2, 4, None} and " <email> " in got[4]


def test_rows_that_share_an_id_or_have_none_are_removed_by_text(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=80))
    first, bare, twin, leak, other = (text() for _ in range(5))
    rows = [(1, first), (None, first), (None, bare), (None, bare), (None, leak), (2, twin), (2, other), (2, other), (2, leak), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(leak.split()[5:40]))], "item_id long, text string")
    order = lambda x: sorted(x, key=repr)
    kept = corpus_pipeline.simhash.deduplicate(docs)
    assert order(map(tuple, kept.collect())) == order([(1, first), (None, bare), (2, twin), (2, other), (2, leak), (None, None)])
    clean = corpus_pipeline.decontam.decontaminate(docs, items)
    assert order(map(tuple, clean.collect())) == order(r for r in rows if r[1] != leak)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
