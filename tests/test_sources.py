import random

import pyarrow as pa
import pytest

from plumbline.sources import facts
from plumbline.sources.store import Store, validate


def varint(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | 128 * (n > 0)])
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def span(*at):
    return b"".join(field(i + 1, v) for i, v in enumerate(at))


def document(uri, symbols, occurrences):
    out = field(1, 4) + field(2, uri) + field(11, "ABC") + field(99, "skipped") + varint(98 << 3 | 5) + b"1234"
    for s, kind, over in symbols:
        out += field(5, field(1, s) + field(3, kind) + b"".join(field(19, o) for o in over))
    for s, role, at in occurrences:
        out += field(6, (field(1, span(*at)) if at else b"") + field(2, s) + field(3, role))
    return field(1, out)


@pytest.fixture()
def decoded(spark, tmp_path):
    a = document("A.scala", [("a/C#", 13, []), ("a/C.", 10, []), ("a/C#`<init>`().", 21, []), ("a/C#x().", 3, []), ("a/C#`x_=`().", 3, []), ("a/C.apply().", 3, ["b/T#apply()."]), ("local0", 19, []), ("a/E.m().", 3, [])], [("a/C#", 2, (0, 6, 0, 7)), ("local0", 1, (3, 0, 3, 5)), ("a/C#", 1, None), ("", 1, (1, 1, 1, 2)), ("a/C#", 7, (1, 1, 1, 2))])
    b = document("B.scala", [("b/O.m().", 3, []), ("local0", 19, [])], [("b/O.m().", 2, (5, 1, 5, 2)), ("local0", 2, (600000, 4, 600000, 5000))])
    (tmp_path / "x").mkdir()
    (tmp_path / "x/ab.semanticdb").write_bytes(a + b)
    (tmp_path / "bad.semanticdb").write_bytes(b"\x0a\xff\x01")
    (tmp_path / "empty.semanticdb").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(a)
    return facts.read_facts(spark, str(tmp_path))


def test_files_decode_and_errors_stay_rows(decoded):
    rows = decoded.collect()
    assert sorted((r["uri"] or "", r["error"] is not None) for r in rows) == [("", True), ("A.scala", False), ("B.scala", False)]


def test_symbols_occurrences_and_edges(decoded):
    docs = decoded.where("error is null").cache()
    occ = {(r["uri"], r["symbol"], r["is_def"]) for r in facts.occurrence_rows(docs).collect()}
    assert occ == {("A.scala", "a/C#", True), ("A.scala", "local0@A.scala", False), ("B.scala", "b/O.m().", True), ("B.scala", "local0@B.scala", True)}
    infos = facts.symbol_infos(docs)
    assert {r["display"] for r in infos.where("uri = 'A.scala'").collect()} == {"C", "<init>", "x", "x_=", "apply", "local0@A.scala", "local0", "m"} - {"local0@A.scala"}
    edges = {tuple(r) for r in facts.alias_edges(infos).collect()}
    assert edges == {("a/C#`<init>`().", "a/C#"), ("a/C#`x_=`().", "a/C#x()."), ("a/C.apply().", "a/C#"), ("a/C#", "a/C.")}
    defined = facts.occurrence_rows(docs).where("is_def").select("symbol")
    assert [tuple(r) for r in facts.forwarders(infos, defined).collect()] == [("a/E.m().", "b/O.m().")]


def test_publish_is_atomic(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.manifest() is None and store.tables() == {}
    store.publish({"t": spark.range(3)})
    held = store.tables()["t"]
    for step in ("t", "manifest", "rename"):

        def fail(now, step=step):
            if now == step:
                raise RuntimeError(step)

        with pytest.raises(RuntimeError):
            store.publish({"t": spark.range(9)}, fail)
        assert store.manifest()["generation"] == 1 and store.tables()["t"].count() == 3
    store.publish({"t": spark.range(5)})
    assert held.count() == 3 and store.tables()["t"].count() == 5
    assert store.janitor() == ["generation-1"] and [tuple(r) for r in store.facts().collect()] == [("t", 5)]


def test_validator_counts_broken_rows(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a")], "doc_ord long, uri string")
    symbols = spark.createDataFrame([(0, "s")], "symbol_ord long, semantic_symbol string")
    posts = spark.createDataFrame([(0, 0, 5, 4, True), (7, 0, 1, 2, True), (0, 3, 1, 2, False)], "doc_ord long, symbol_ord long, ps long, pe long, is_def boolean")
    got = dict(tuple(r) for r in validate(posts, docs, symbols).collect())
    assert got == {"span is not inverted": 1, "document exists": 1, "symbol exists": 1, "symbol is unique": 0, "document is unique": 1, "one definition": 1}


def test_fact_files_are_written_and_read_by_columns():
    """The same bytes and rows as one message at a time: long and missing parts, negative numbers, unknown order, and each different part is taken apart once (F1)."""
    rng = random.Random(1)
    no = dict.fromkeys(("start_line", "start_character", "end_line", "end_character"))
    span = lambda k: {"start_line": k - 2, "start_character": rng.choice([0, 1, 300, 70000]), "end_line": k, "end_character": None if k % 7 == 0 else 5}
    symbols = lambda i: [{"symbol": f"a/{k}" * (k % 40), "kind": k % 3, "properties": 0, "display_name": "" if k % 2 else "n", "overridden_symbols": ["q"] * (k % 3)} for k in range(i)]
    docs = [{"uri": f"u{i}", "schema": 4, "language": 1, "text": "é" * (i * 50), "md5": "x" if i else None, "symbols": None if i == 3 else symbols(i), "occurrences": None if i == 2 else [{"symbol": "s" * rng.choice([0, 3, 140]), "role": k % 3, **(no if k % 5 == 0 else span(k))} for k in range(i * 3)]} for i in range(6)]
    batch = pa.RecordBatch.from_pylist([d | {"path": "p", "error": None} for d in docs], schema=facts.ARROW)
    raw = facts.encoded(docs)
    assert b"".join(facts.messages(batch)) == raw and facts.messages(batch.slice(3, 2)) == facts.messages(batch)[3:5]
    rows = facts.rows_of("p", raw)
    slow = [d | {"path": "p", "error": None} for d in facts.documents(raw)]
    assert facts.batch_of(rows).equals(pa.RecordBatch.from_pylist(slow, schema=facts.ARROW))
    late = facts.message([(3, 2), (1, facts.message([(1, 7), (3, 7)])), (2, "z")])  # the span stands between the others
    assert facts.rows_of("p", facts.message([(1, facts.message([(6, late)]))]))[0]["occurrences"] == [("z", 2, 7, 0, 7, 0)]
    assert facts.batch_of([{"path": "p", "error": "e"}, *rows]).to_pylist()[0]["occurrences"] is None
    assert "bad" in facts.rows_of("p", facts.message([(1, facts.message([(6, b"\x0a\x02\x08\xff\x18\x01")]))]))[0]["error"]
    many = facts._Kept(lambda x: x)
    assert [many[k] for k in range(facts.KEPT + 2)][-1] == facts.KEPT + 1 and len(many) <= facts.KEPT
