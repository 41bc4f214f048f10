import random
import zlib
from heapq import nlargest

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece

from plumbline.llm import pieces
from plumbline.llm.queries import op3_sentencepiece

PATH = P.path("piece_bpe_32k.model")


def every(m, text):
    """All segmentations of a marked text."""
    if not text:
        return [(0, ())]
    out = []
    for k in range(1, min(len(text), m.longest) + 1):
        known = m.pieces.get(text[:k])
        if known or k == 1:
            own = (known[0],) if known else tuple(m.bytes[b] for b in text[0].encode())
            out += [((known[1] if known else m.unknown) + s, own + ids) for s, ids in every(m, text[k:])]
    return out


def test_n_best_equals_enumeration():
    m, rng = pieces.model(PATH), random.Random(6)
    for text in ["a", "the", "ab c", "aaaa", "é\n", "  x", "in the", "日本", "𝔘 a"] + ["".join(rng.choices("aetin o", k=9)) for _ in range(30)]:
        _, ids, scores, sizes = pieces.segment(text, pieces.Words(m), 4)
        found = sorted(every(m, pieces.MARK + text.replace(" ", pieces.MARK)), key=lambda x: -x[0])
        assert scores == [s for s, _ in found[:4]]
        best = [i for s, i in found if s == scores[0]]
        assert tuple(np.frombuffer(ids, "<i4").tolist()) in best
        assert len(sizes) == len(scores)


def test_arrays_give_what_single_words_give():
    m, rng = pieces.model(PATH), random.Random(3)
    words = {pieces.MARK + "".join(rng.choices("aeiountrs", k=rng.randint(1, 12))) for _ in range(3000)} | {"▁é" * 1 + "x" * k for k in range(20)} | {"𝔘ab" + c for c in "abcdefghijkl"}
    fast, slow = pieces.Words(m), pieces.Words(m)
    fast.fill(words)
    for w in words:
        a, b = fast[w], slow[w]
        assert (fast.scores[a], fast.costs[a], fast.rows[a], fast.owns[a]) == (slow.scores[b], slow.costs[b], slow.rows[b], slow.owns[b]), w


def test_decoding_agrees_with_the_library():
    m, sp = pieces.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["Hello  world\n\tx ", " lead", "", "ñandú 日本 😀", "a" * 300, "\x00\x7f"]:
        own, best = (np.frombuffer(raw, "<i4").tolist() for raw in pieces.segment(text, pieces.Words(m), 4)[:2])
        assert own == sp.encode(text)
        for raw in (own, best):
            assert pieces.decode(raw, m) == text == sp.decode(raw)


def whole_text(m, text, n):
    """Scores of the n best segmentations of a whole text, by the n best of every position."""
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    at = [[0]]
    for j in range(1, len(marked) + 1):
        found = []
        for i in range(max(0, j - m.longest), j):
            known = m.pieces.get(marked[i:j])
            if known or i == j - 1:
                cost = known[1] if known else m.unknown
                found += [x + cost for x in at[i]]
        at.append(nlargest(n, found))
    return at[-1]


def test_rows_equal_the_library_and_the_n_best_of_whole_texts(spark):
    """All documents of the smallest tables: own ids by the library, N-best scores by a search that knows no words."""
    m, sp = pieces.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        own, row = np.array(sp.encode(text), "<i4"), got[d]
        assert (row["n_pieces"], row["ids_crc32"]) == (len(own), zlib.crc32(own.tobytes())), d
        if len(text) < 6_000:
            assert row["nbest_scores"] == [x / pieces.UNIT for x in whole_text(m, text, 4)], d


@pytest.mark.parametrize("text", ["  two  spaces ", "\n\n x\ty", "日本語 text 日", "▁a▁▁b", "𝔘𝔫𝔦 code", "<s> </s> <unk> <0x0A>", "\r\n", " ", "a\u0301e\u200bx", "ＡＢ ﬁ ½"])
def test_own_ids_equal_the_library(text):
    own = np.frombuffer(pieces.segment(text, pieces.Words(pieces.model(PATH)), 4)[0], "<i4").tolist()
    assert own == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_ids_of_all_documents_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, PATH, ids=True).collect()}
    assert all(own[r["doc_id"]] == sp.encode(r["text"] or "") for r in docs.collect())


def test_query_round_trip(spark, tmp_path, monkeypatch):
    got = op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r["decoded"] for r in got)
    assert all(r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) and r["nbest_scores"][0] == r["best_score"] for r in got)
    rows = [(0, None), (None, "no id"), (1, ""), (2, "x" * 60_000), (3, "a▁b"), (3, "a▁b"), (4, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, n_pieces int, ids array<int>")
    found = pieces.encode(df, PATH, ids=True)
    assert all(r["decoded"] for r in found.collect())
    text = {r["doc_id"]: r["text"] for r in pieces.decode_frame(found, PATH).collect()}
    assert text == {0: "", None: "no id", 1: "", 2: "x" * 60_000, 3: "a b", 4: "word " * 20_000}
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_long_word_by_stretches_equals_the_whole(monkeypatch):
    m, rng = pieces.model(PATH), random.Random(9)
    text = "".join(rng.choices("aeinorst", k=3000)) + "é日x" * 50
    whole = pieces.segment(text, pieces.Words(m), 4)
    monkeypatch.setattr(pieces, "_FAR", 64)
    assert pieces.segment(text, pieces.Words(m), 4) == whole


def test_long_text_without_a_space():
    m, text = pieces.model(PATH), "tion" * 100_000
    own, raw, scores, _ = pieces.segment(text, pieces.Words(m), 4)
    assert all(pieces.decode(np.frombuffer(x, "<i4").tolist(), m) == text for x in (own, raw)) and len(scores) == 4


def test_generations_give_what_one_gives(monkeypatch):
    m, rng = pieces.model(PATH), random.Random(8)
    texts = [" ".join("".join(rng.choices("aeinot", k=rng.randint(1, 6))) for _ in range(60)) for _ in range(30)]
    whole = list(pieces.segments(texts, pieces.Words(m), 4))
    monkeypatch.setattr(pieces, "CACHED", 50)
    words = pieces.Words(m)
    assert [x for t in texts for x in pieces.segments([t], words, 4)] == whole
