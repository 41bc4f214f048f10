import random

import public_tokenizers as P
from tokenizers import Tokenizer

from plumbline.llm.queries import op1_token_counts

PATH = P.path("byte_bpe_50k.json")


def write(spark, path, rows):
    spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, n_bytes string, n_tokens int").coalesce(2).write.parquet(f"{path}/documents.parquet")


def test_counts_equal_the_library(spark, tmp_path):
    rng = random.Random(2)
    odd = ["՘", "\U0001df1f", "é", " ", "　", "😀", "١", "ñ", "<|endoftext|>", "'s", "don't", " ", "  ", "\n\n", "\t", "\x1c", "\x85", "abc", "1234", "!!", "<|endo", "ftext|>", "ー", "का"]
    rows = [(0, None), (1, ""), (2, " "), (3, "<|endoftext|>"), (4, "a" * 50_000), (5, "x <|endoftext|> y"), (6, "word " * 20_000), (6, "word " * 20_000)]
    rows += [(i, "".join(rng.choices(odd, k=rng.randint(1, 40)))) for i in range(7, 400)]
    write(spark, tmp_path, rows)
    t = Tokenizer.from_file(PATH)
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in op1_token_counts(spark, str(tmp_path)).collect())
    assert got == want


def test_limit_and_real_rows(spark):
    t = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r["n_tokens"] == len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 512)


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert op1_token_counts(spark, str(tmp_path)).count() == 0
