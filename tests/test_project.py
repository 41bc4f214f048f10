import hashlib
import json
import random

from pyspark.sql import functions as F

from plumbline.functions import lexical, uris
from plumbline.operators import rename
from plumbline.operators.ingest import ingest
from plumbline.plans.plugins import Plugins
from plumbline.sources import facts, project
from tests.test_sources import document


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").select("k", make(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("k").collect()]


def test_uris(spark):
    paths = ["/a b/ü+%.scala", "/x~y_z-1.2*", "/"]
    coded = column(spark, paths, uris.path_to_uri)
    assert coded == ["file:///a%20b/%C3%BC%2B%25.scala", "file:///x~y_z-1.2%2A", "file:///"]
    assert column(spark, coded, uris.uri_to_path) == paths
    assert column(spark, ["file:/a%20b", "file://host/a", "http://a", "file:///a%2", "file:", "file:///a+b"], uris.uri_to_path) == ["/a b", None, None, None, None, "/a+b"]
    assert column(spark, ["/a/./b/../c//d", "/..", "a/..", "/"], uris.normalize_path) == ["/a/c/d", "/", "", "/"]
    assert column(spark, ["file:/a/../b", "file://h/a/../b", "x"], uris.normalize_uri) == ["file:///b", "file://h/a/../b", "x"]


def test_lexical_scans(spark):
    text = "object Main\n  class In\nfinal case  class Ünder\nprivate final val x_1$ = 2\ndefine x\n😀\nsealed trait T extends"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    decls = lexical.top_level_decls(docs)
    got = [(r["line"], r["keyword"], r["name"], r["start"], r["end"]) for r in decls.orderBy("line").collect()]
    assert got == [(0, "object", "Main", 7, 11), (3, "val", "x_1$", 18, 22), (6, "trait", "T", 13, 14)]
    known = spark.createDataFrame([("Main",)], "display string")
    assert [r["name"] for r in lexical.unsaved_only(decls, known, "T").collect()] == ["T"]
    assert column(spark, ["Not found: type Foo$1 - did", "Not found: x", "value x is"], lexical.missing_symbol) == ["Foo$1", "x", None]
    assert column(spark, ["class A needs to be abstract", "ok"], lexical.not_implemented) == [True, False]
    only = F.array(F.lit("refactor"), F.lit("quickfix"))
    assert column(spark, ["refactor.rewrite", "refactoring", "quickfix"], lambda c: lexical.kind_allowed(c, only)) == [True, False, True]
    assert column(spark, ["Picked up X\n at a.b\n\nboom  \nDownloading y", " \n"], lexical.stderr_tail) == ["boom", "(no stderr)"]


def test_minimal_edits_rebuild_the_text(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("ab\n", k=12)), "".join(rng.choices("ab\n", k=12))) for _ in range(50)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", lexical.minimal_edits("a", "b").alias("e")).collect():
        lines = r["a"].splitlines(keepends=True)
        for e in reversed(r["e"]):
            lines[e["line"] : e["line"] + e["removed"]] = [e["text"]]
        assert "".join(lines) == r["b"]
    assert lexical.line_edits("a", "a") == []


def test_scripts_are_shortest():
    """Against the table of all prefixes, over few and many different lines, and one pair of long texts."""
    rng = random.Random(4)
    for k in range(400):
        x, y = (["".join(rng.choices("abcd"[: 1 + k % 4])) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        found = lexical.common_lines(x, y)
        assert len(found) == best[-1][-1] and all(x[i] == y[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    long = [str(i) for i in range(60_000)]
    other = long[:100] + ["new"] + long[101:40_000] + long[40_003:]
    assert len(lexical.common_lines(long, other)) == 60_000 - 4


def test_project_model(spark, tmp_path):
    (tmp_path / ".bsp").mkdir()
    for name, body in {"b.json": {"name": "zinc", "argv": ["z"]}, "a.json": {"name": "mill", "argv": ["m"]}, "c.json": {"name": "x", "argv": []}, "d.json": None}.items():
        (tmp_path / ".bsp" / name).write_text("{oops" if body is None else json.dumps(body))
    got = [(r["file"], r["error"]) for r in project.connections(spark, str(tmp_path)).collect()]
    assert got[:2] == [("a.json", None), ("b.json", None)] and {e for _, e in got[2:]} == {"missing required field 'argv'", "malformed JSON"}
    options = [("t/a", ["-Xsemanticdb", "-semanticdb-target:one", "-semanticdb-target", "../two", "-sourceroot", "/src"], "/cls"), ("t/b", ["-Ysemanticdb"], "/cls/b"), ("t/c", ["-sourceroot", "-Xsemanticdbx"], "/cls")]
    opts = spark.createDataFrame(options, "target string, options array<string>, class_directory string")
    roots = {r["target"]: (r["semanticdb_root"], r["sourceroot"]) for r in project.fact_roots(opts, "/ws").collect()}
    assert roots == {"t/a": ("/two", "/src"), "t/b": ("/cls/b", "/ws"), "t/c": (None, "/ws/-Xsemanticdbx")}
    targets = spark.createDataFrame([("t/a", ["scala"], "3.4.1", ["t/b", "gone"]), ("t/b", ["scala", "java"], "3", []), ("t/c", ["scala"], "2.13", []), ("t/d", ["java"], "3", [])], "uri string, language_ids array<string>, scala_version string, deps array<string>")
    model = project.load(targets, opts, "/ws")
    assert {(r["bsp_id"], r["indexable"]) for r in model.collect()} == {("t/a", True), ("t/b", True)}
    assert [tuple(r) for r in project.dependency_edges(model).collect()] == [("t/a", "t/b")]
    sources = spark.createDataFrame([("t/a", "file:///s/", True), ("t/b", "file:///s/x/B.scala", False), ("t/b", "file:///n.txt", False)], "target string, uri string, directory boolean")
    files = spark.createDataFrame([("/s/A.scala",), ("/s/x/B.scala",), ("/s2/C.scala",), ("/s/r.md",)], "path string")
    expanded = project.expand_sources(sources, files)
    assert {tuple(r) for r in expanded.collect()} == {("t/a", "/s/A.scala"), ("t/a", "/s/x/B.scala"), ("t/b", "/s/x/B.scala")}
    order = spark.createDataFrame([("t/b", 0), ("t/a", 1)], "target string, n int")
    assert dict(tuple(r) for r in project.owner_of(expanded, order).collect()) == {"/s/A.scala": "t/a", "/s/x/B.scala": "t/b"}


def test_ingest_and_rename(spark, tmp_path):
    a = document("A.scala", [("a/C#", 13, []), ("a/C.", 10, []), ("a/C#m().", 3, [])], [("a/C#", 2, (0, 6, 0, 7)), ("a/C#m().", 2, (1, 6, 1, 7)), ("a/C.", 1, (2, 0, 2, 1))])
    b = document("B.scala", [("b/D#", 13, [])], [("b/D#", 2, (0, 6, 0, 7)), ("a/C#m().", 1, (4, 2, 4, 3)), ("z/Z#", 1, (5, 0, 5, 1))])
    (tmp_path / "f.semanticdb").write_bytes(a + b)
    (tmp_path / "bad.semanticdb").write_bytes(b"\x08")
    decoded = facts.read_facts(spark, str(tmp_path)).withColumn("target_ord", F.lit(0))
    doc_facts = spark.createDataFrame([("B.scala", True, False, False)], "uri string, generated boolean, readonly boolean, dependency_source boolean")
    previous = spark.createDataFrame([("A.scala", 4, "OLD")], "uri string, prev_epoch int, prev_md5 string")
    out = ingest(decoded, doc_facts, previous)
    assert {r["uri"]: (r["epoch"], r["doc_ord"]) for r in out["doc"].collect()} == {"A.scala": (5, 0), "B.scala": (1, 1)}
    groups = {r["symbol"]: r["group_symbol"] for r in out["symbol"].collect()}
    assert groups["a/C."] == groups["a/C#"] and groups["a/C#m()."] == "a/C#m()." and [r["symbol"] for r in out["symbol"].orderBy("symbol_ord").collect()] == sorted(groups)
    report = dict(tuple(r) for r in out["report"].collect())
    assert report["shared"] == 0 and report["groups"] == len(set(groups.values())) and report["rename_tokens"] == out["rename"].count()
    assert report["documents"] == 2 and report["errors"] == 1 and report["symbols"] == 5 and report["occurrences"] == 6
    profile = {r["group_symbol"]: r for r in out["profile"].collect()}
    assert profile["z/Z#"]["is_external"] and profile["a/C#m()."]["has_generated"] and profile[groups["a/C#"]]["editable_count"] == 2

    members = out["symbol"].select("symbol_ord", F.col("group_symbol").alias("component"))
    mask = F.when(F.col("is_external"), 1).otherwise(0) + F.when(F.col("has_generated"), 2).otherwise(0)
    profiles = out["profile"].select(F.col("group_symbol").alias("component"), mask.cast("long").alias("unsafe_mask"))
    asked = spark.createDataFrame([(groups["a/C#"], "New"), (groups["a/C#"], "a`b"), ("a/C#m().", "n"), ("no", "n")], "component string, new_name string")
    got = {(r["component"], r["new_name"]): r for r in rename.plan(asked, profiles, out["occurrence"], members).collect()}
    ok = got[groups["a/C#"], "New"]
    assert ok["status"] == "ok" and ok["n_edits"] == 2 and [(e["line"], e["char"]) for e in ok["edits"]] == [(0, 6), (2, 0)]
    assert got[groups["a/C#"], "a`b"]["status"] == "bad name" and got["no", "n"]["status"] == "NotIndexed"
    assert got["a/C#m().", "n"]["reasons"] == ["symbol has occurrences in generated sources"]
    texts = spark.createDataFrame([("A.scala", "changed", "00")], "uri string, text string, md5 string")
    assert rename.plan(asked.limit(1), profiles, out["occurrence"], members, texts).first()["status"] == "StaleIndex"


def test_ingest_counts_shared_skipped_stale_and_shown_tokens(spark):
    occ = [("a/C#", 2, 0, 6, 7), ("a/C#m().", 2, 1, 6, 7), ("a/C#m().", 1, 2, 0, 1), ("a/C#m().", 1, 2, 4, 5)]
    text = "class C\n  def m\nm + n"
    doc = {"path": "p", "error": None, "uri": "A.scala", "schema": 4, "language": 1, "text": text, "md5": hashlib.md5(text.encode()).hexdigest().upper(),
           "symbols": [{"symbol": "a/C#", "kind": 13, "properties": 0x200000, "display_name": "C", "overridden_symbols": []}, {"symbol": "a/C#m().", "kind": 3, "properties": 0, "display_name": "m", "overridden_symbols": ["z/B#m()."]}],
           "occurrences": [{"symbol": s, "role": r, "start_line": n, "start_character": a, "end_line": n, "end_character": b} for s, r, n, a, b in occ]}
    decoded = spark.createDataFrame([doc | {"target_ord": 0}, doc | {"target_ord": 1, "path": "q", "md5": "OLD"}], facts.SCHEMA + ", target_ord int")
    none = spark.createDataFrame([], "uri string, generated boolean, readonly boolean, dependency_source boolean")
    out = ingest(decoded, none, skipped=spark.createDataFrame([("gone",)], "uri string"))
    report = dict(tuple(r) for r in out["report"].collect())
    assert report == {"documents": 1, "shared": 1, "stale": 1, "errors": 0, "symbols": 2, "groups": 2, "occurrences": 4, "rename_tokens": 3, "skipped": 1}
    profile = {r["group_symbol"]: r for r in out["profile"].collect()}
    assert (profile["a/C#"]["mask"], profile["a/C#m()."]["mask"]) == (512, 8) and profile["a/C#m()."]["rename_count"] == 2


def test_expected_tokens(spark):
    rows = [("a/C#`<init>`().", "<init>", "C"), ("a/C#`x_=`().", "x_=", "x"), ("a/C#m(+1).", "m", "m"), ("local1", "v", "v"), ("a/T.", "T", "T"), ("", "", None)]
    df = spark.createDataFrame(rows, "s string, d string, want string").withColumn("got", rename.expected_token(F.col("s"), F.col("d")))
    assert all(r["got"] == r["want"] for r in df.collect())
    line = spark.createDataFrame([("val `x` = y", 4, 7, True, "x", True), ("val x", 4, 5, True, "y", False), ("val x", 4, 5, False, "x", False), ("", 0, 1, True, None, True)], "l string, a int, b int, o boolean, e string, want boolean")
    assert all(r["want"] == r["got"] for r in line.withColumn("got", rename.token_matches(F.col("l"), F.col("a"), F.col("b"), F.col("o"), F.col("e"))).collect())


class Adds:
    id = "adds"

    def after(self, request, rows):
        return rows.union(rows.sparkSession.createDataFrame([(99,)], rows.schema)).where("x <> 1")


class Fails:
    id = "fails"

    def after(self, request, rows):
        return rows.select("no_such_column")


def test_plugins_cannot_pass_rows_off(spark):
    plugins = Plugins()
    plugins.register(Fails())
    plugins.register(Adds())
    got = plugins.apply("definition", spark.createDataFrame([(0,), (1,), (2,)], "x int"))
    assert sorted(map(tuple, got.select("x", "origin").collect())) == [(0, "workspace"), (2, "workspace"), (99, "adds")]
    assert list(plugins.disabled) == ["fails"] and [p.id for p in plugins.active] == ["adds"]
