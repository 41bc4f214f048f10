from collections import Counter

from plumbline.llm import quality
from plumbline.llm.queries import OP6_SQL, op6_quality_rules
from tests.llm.oracle import compare


def test_matches_sql(spark):
    compare(spark, op6_quality_rules, OP6_SQL)


def test_repeat_words_by_hand():
    for text in ("", "a", "a b c", "a b c a b c", "x x x x x", "a b c d a b e a b c", "one two " * 50):
        w = text.encode().split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        assert quality.repeat_words(w) == len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})


def test_edges_and_hosts(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"a{i} ###" for i in range(60))
    lines = "\n".join([good, "same line", "same line", "same line", "same line"])
    rows = [(0, None, "h"), (1, "", "h"), (2, good, None), (3, good, "bad"), (4, lines, "bad"), (5, lines, "fine"), (2, good, None)]
    rows += [(10 + i, junk, "bad") for i in range(3000)] + [(4000 + i, good, "fine") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "'x' as host", "'y' as kept", "2 as c0")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op6_quality_rules(spark, str(tmp_path)).collect()}
    assert not got[0]["kept"] and got[0]["base_failed"] and got[0]["n_words"] == 0
    assert got[2]["kept"] and got[3]["kept"] and got[5]["kept"] and not got[4]["kept"] and not got[4]["base_failed"]
    assert not any(got[10 + i]["kept"] for i in range(3000))
    assert op6_quality_rules(spark, str(tmp_path)).count() == len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_quality_rules(spark, str(tmp_path)).count() == 0


def test_very_long_text(spark):
    text = "alpha beta gamma delta\n" * 100_000
    row = quality.judge(spark.createDataFrame([(1, text, "h", 5)], "doc_id long, text string, source string, c1 int"), ["doc_id", "c1"]).first()
    assert (row["#n_words"], row["#word_chars"], row["#n_dup_lines"], row["#n_repeat_words"]) == (400_000, 1_900_000, 99_999, 400_000)
    assert row["c1"] == 5 and row["#base_failed"] and not row["#kept"]


def test_stage_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, kept int")
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns
