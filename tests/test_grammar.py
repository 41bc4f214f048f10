import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bits, hashes
from plumbline.functions import symbols as g


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name, token", [("_", "`_`"), ("+", "+"), ("é1", "é1"), ("a_+", "a_+"), ("_+", "_+"), ("a+", "`a+`"), ("val", "`val`"), ("=>", "`=>`"), ("x y", "`x y`"), ("1a", "`1a`"), ("", None), ("a`b", None), ("a\nb", None), ("$a_", "$a_"), ("::", "::"), ("a_b_*", "a_b_*")])
def test_rename_tokens(spark, name, token):
    assert one(spark, g.rename_token(F.col("s")), s=name) == token


@pytest.mark.parametrize("symbol, package, owner, top, local", [
    ("a/b/C#m().", "a.b", "C", "a/b/C#", False), ("a/b/C#", "a.b", None, "a/b/C#", False), ("a/b/", "a", None, None, False), ("_empty_/X.y.", None, "X", "_empty_/X.", False),
    ("local3", None, None, None, True), ("local", None, None, None, False), ("a/`local x`#D#e.", "a", "D", "a/`local x`#", False), ("a/C#m().(p)", "a", "m", "a/C#", False),
])
def test_owners(spark, symbol, package, owner, top, local):
    s = F.col("s")
    got = one(spark, F.struct(g.package_name(s).alias("p"), g.owner_name(s).alias("o"), g.enclosing_top_level(s).alias("t"), g.is_local(s).alias("l"), g.is_global(s).alias("g")), s=symbol)
    assert (got["p"], got["o"], got["t"], got["l"], got["g"]) == (package, owner, top, local, not local)


def test_constructors_setters_and_companions(spark):
    s = F.col("s")
    assert one(spark, g.is_constructor(s), s="a/B#`<init>`(+1).") and not one(spark, g.is_constructor(s), s="a/B#init().")
    assert one(spark, g.setter_target(s), s="a/B#`x_=`().") == "x" and one(spark, g.setter_target(s), s="a/B#`_=`().") is None
    assert one(spark, g.is_companion_pair(s, F.col("t")), s="a/B#", t="a/B.") and not one(spark, g.is_companion_pair(s, F.col("t")), s="a/B#", t="a/C.")
    assert tuple(one(spark, g.descriptor_split(s), s="a/B#m(+2).")) == ("a/B#", "m(+2).") and one(spark, g.descriptor_split(s), s="local1") is None


@pytest.mark.parametrize("key, symbol, doc", [("local0@42", "local0", 42), ("local0@x", "local0@x", None), ("a/B#", "a/B#", None), ("local1@18446744073709551615", "local1", 2**64 - 1), ("local1@18446744073709551616", "local1@18446744073709551616", None), ("local1@", "local1@", None)])
def test_keys(spark, key, symbol, doc):
    got = one(spark, g.decode_key(F.col("s")), s=key)
    assert (got["symbol"], None if got["doc"] is None else int(got["doc"])) == (symbol, doc)


def test_bit_sets_equal_python_sets(spark):
    rng = random.Random(4)
    rows = [(rng.sample(range(200), rng.randint(0, 30)), rng.sample(range(200), rng.randint(0, 5)), rng.randrange(220)) for _ in range(60)] + [([], [], 0), ([0, 63, 64, 127], [63], 64)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, n int")
    a, b = bits.of(F.col("a")), bits.of(F.col("b"), 200)
    for r in df.select("a", "b", "n", bits.members(a).alias("m"), bits.cardinality(a).alias("c"), bits.intersects(a, b).alias("i"), bits.contains(a, F.col("n")).alias("has"), bits.members(bits.all_of(70)).alias("all")).collect():
        assert r["m"] == sorted(r["a"]) and r["c"] == len(r["a"]) and r["i"] == bool(set(r["a"]) & set(r["b"])) and r["has"] == (r["n"] in r["a"]) and r["all"] == list(range(70))


def test_hashes(spark):
    assert hashes.fnv1a(b"") == 0xCBF29CE484222325 and hashes.fnv1a(b"a") == 0xAF63DC4C8601EC8C and hashes.crc32c(b"123456789") == 0xE3069283
    df = spark.createDataFrame([("a",), (None,), ("a",)], "s string").select(hashes.id_of(F.col("s")).alias("i"), hashes.checksum32c(F.col("s")).alias("c")).collect()
    assert [r["i"] for r in df] == [0xAF63DC4C8601EC8C >> 1, None, 0xAF63DC4C8601EC8C >> 1] and df[1]["c"] is None
