import time
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from plumbline.functions import uris
from plumbline.operators import rename, workspace
from plumbline.plans.plugins import Plugins
from plumbline.sources import facts, layout
from plumbline.sources.store import Store
from plumbline.streaming import folds, heal


def slow_cache(rows, cap):
    held, out = {}, []
    for session, seq, uri, kind, previous in rows:
        own = held.setdefault(session, OrderedDict())
        mine = own.pop(uri, 0)
        if kind != "close":
            own[uri] = mine + 1
            out.append((session, seq, mine + 1, mine > 0 and previous == mine))
            while len(own) > cap:
                own.popitem(last=False)
    return sorted(out)


def test_token_results_equal_an_ordered_cache(spark):
    from plumbline.plans import projections as p
    from plumbline.plans.workspace_queries import token_results

    path = "/root/testdata/sf0.001"
    rows = p.notifications(spark, path).where("kind in ('change', 'open', 'close')").orderBy("seq").collect()
    rows = [(str(r["target"]), r["seq"], r["uri"], r["kind"], r["seq"] % 4) for r in rows]
    got = sorted(map(tuple, token_results(spark, path).collect()))
    assert got == slow_cache(rows, 32) and any(d for *_, d in got)


def test_a_streams_last_window_fires_by_its_timer(spark, tmp_path):
    schema = "uri string, seq long, at long, compile boolean"
    spark.createDataFrame([("a", 0, 0, False), ("a", 1, 400, True), ("a", 2, 500, False), ("b", 0, 7, False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    made = folds.stream(source, "uri", "seq", folds.debounce_fold(500), "opened long, n long, compile_first boolean", folds.debounce_end, 500)
    run = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    want, until = [("a", 0, 2, True), ("a", 500, 1, False), ("b", 7, 1, False)], time.time() + 60
    got = []
    while time.time() < until and got != want:
        time.sleep(1)
        try:
            got = sorted(map(tuple, spark.read.schema("uri string, opened long, n long, compile_first boolean").parquet(f"{tmp_path}/out").collect()))
        except Exception:  # noqa: BLE001  nothing written yet
            got = []
    run.stop()
    assert got == want


def test_pulls_are_armed_once_and_disarmed():
    fold = folds.pull_fold(300)
    state, out = fold(None, {"kind": "change", "at": 0})
    state, out = fold(state, {"kind": "change", "at": 200})
    assert state == {"armed": 0} and out == []
    state, out = fold(state, {"kind": "save", "at": 299})
    assert state is None and out == []
    state, out = fold(state, {"kind": "change", "at": 299})
    state, out = fold(state, {"kind": "close", "at": 599})
    assert state is None and out == [(299, 599)]


def test_fact_files(spark):
    df = spark.createDataFrame([("/r/x", "a/B.scala"), ("/r/x", "../B.scala"), ("/r/x", "/B.scala"), ("/r/x", ""), ("/r/x/", "a/../c.scala")], "root string, source string")
    got = [r[0] for r in df.select(uris.fact_file(F.col("root"), F.col("source"))).collect()]
    assert got == ["/r/x/a/B.scala.semanticdb", None, None, None, "/r/x/c.scala.semanticdb"]
    df = spark.createDataFrame([("/r/x", "/r/x/a/B.scala.semanticdb"), ("/r/x", "/r/xy/B.semanticdb"), ("/r/x", "/r/x/.semanticdb"), ("/r/x", "/r/x/a.txt")], "root string, file string")
    assert [r[0] for r in df.select(uris.source_of(F.col("root"), F.col("file"))).collect()] == ["a/B.scala", None, None, None]


def test_sources_without_a_text_are_skipped(spark):
    docs, texts = spark.createDataFrame([("a", 1), ("b", 2)], "uri string, n int"), spark.createDataFrame([("a", "x")], "uri string, text string")
    good, lost = facts.with_texts(docs, texts)
    assert [tuple(r) for r in good.select("uri", "text").collect()] == [("a", "x")] and [r[0] for r in lost.collect()] == ["b"]


def test_raw_facts_of_other_states(spark):
    md5 = "9DD4E461268C8034F5C8564E155C67A6"  # of x
    raw = spark.createDataFrame([("a", md5.lower(), "s", 1, 2, True), ("b", "0", "s", 1, 2, True)], "uri string, md5 string, symbol string, ps long, pe long, is_def boolean")
    texts, sources = spark.createDataFrame([("a", "x"), ("b", "x")], "uri string, text string"), spark.createDataFrame([("c",)], "uri string")
    asked = spark.createDataFrame([(u, "s") for u in "abcd"] + [("a", "t")], "uri string, symbol string")
    got = {(r["uri"], r["symbol"]): (r["status"], r["ps"]) for r in workspace.raw_fallback(asked, raw, texts, sources).collect()}
    assert got == {("a", "s"): ("ok", 1), ("a", "t"): ("ok", None), ("b", "s"): ("StaleIndex", None), ("c", "s"): ("NoSemanticdb", None), ("d", "s"): ("NotIndexed", None)}


def test_tokens_in_dirty_buffers(spark):
    buffers = spark.createDataFrame([("a", "val x_1 = 😀b\r\n  $y"), ("b", "clean")], "uri string, text string")
    dirty = spark.createDataFrame([("a", True), ("b", False)], "uri string, dirty boolean")
    asked = [("a", 0, 4), ("a", 0, 7), ("a", 0, 8), ("a", 0, 12), ("a", 0, 11), ("a", 1, 99), ("a", 7, 0), ("b", 0, 0)]
    got = sorted(tuple(r) for r in workspace.overlay_at(spark.createDataFrame(asked, "uri string, line int, char int"), buffers, dirty).collect())
    assert got == [("a", 0, 4, 4, 7), ("a", 0, 7, 4, 7), ("a", 0, 12, 12, 13), ("a", 1, 99, 2, 4)]


def test_first_of_each_and_answers_before_ready(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "v string, n int")
    assert [r["v"] for r in workspace.first_of_each(df, ["v"], ["n"]).orderBy("n").collect()] == ["b", "a"]
    rows = spark.createDataFrame([("rename",), ("hover",), ("completion",), ("other",)], "m string").select(workspace.before_ready(F.col("m")))
    assert [r[0] for r in rows.collect()] == ["error", "null", "empty", None]


def test_layouts_and_checked_generations(spark, tmp_path):
    rows = [(k, s, d, d * 10, d * 10 + 1, k % 7 == 0, d % 3) for k, (s, d) in enumerate((s, d) for s in range(5) for d in range(20))]
    posts = spark.createDataFrame(rows, "seq long, symbol_ord long, doc_ord long, ps long, pe long, is_def boolean, target_ord int").withColumn("editable", F.lit(True)).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    store = Store(spark, f"file://{tmp_path}/store")
    store.publish(layout.by_group(posts, 3, 8) | layout.by_document(posts, 3, 8))
    tables = store.tables()
    assert tables["group_posting"].count() == 100 and tables["block_index"].count() == 15 and tables["interval_index"].agg(F.sum("records")).first()[0] == 100
    assert layout.records(tables["group_posting"], tables["block_index"].where("symbol_ord = 2 and block_no = 1"), "symbol_ord").count() == 8
    rule = lambda broken: lambda t: t["t"].agg(F.lit(broken).cast("long").alias("broken")).select(F.lit("a rule").alias("rule"), "broken")
    with pytest.raises(ValueError, match="a rule: 2 rows"):
        store.publish({"t": spark.range(1)}, rules=rule(2))
    assert store.manifest()["generation"] == 1
    with store.pin() as held:
        store.publish({"t": spark.range(4)}, rules=rule(0))
        assert store.janitor() == [] and held["group_posting"].count() == 100
    assert store.janitor() == ["generation-1"] and store.dump() == "generation 2\nt: 4 rows"
    reader = Store(spark, f"file://{tmp_path}/store", readonly=True)
    assert reader.tables()["t"].count() == 4 and reader.janitor() == []
    with pytest.raises(PermissionError):
        reader.publish({"t": spark.range(1)})
    state = layout.state(spark.createDataFrame([("a", 3, "M")], "uri string, epoch int, md5 string")).first()
    assert tuple(state) == ("a", 3, "M")


def test_stale_reads_and_changed_facts_start_an_ingest(spark, tmp_path):
    store, read = Store(spark, f"file://{tmp_path}/store"), []
    rebuild = lambda: {"t": spark.range(2)}
    on_read = heal.on_stale_reads(store, rebuild)
    on_read(spark.createDataFrame([("a", False)], "uri string, stale boolean"), 0)
    assert store.manifest() is None
    on_read(spark.createDataFrame([("a", True), ("b", True)], "uri string, stale boolean"), 1)
    assert store.manifest()["generation"] == 1
    on_files = heal.on_watched_files(store, rebuild, lambda: read.append(1))
    on_files(spark.createDataFrame([("/w/x.txt",), ("/w/.workspace/config.json",)], "path string"), 0)
    assert store.manifest()["generation"] == 1 and read == [1]
    on_files(spark.createDataFrame([("/w/x.semanticdb",)], "path string"), 1)
    assert store.manifest()["generation"] == 2 and heal.reingest(store, None) is None


def test_renames_are_refused_if_targets_do_not_compile(spark):
    planned = spark.createDataFrame([(1, "ok", ["x"], 1, None), (2, "StaleIndex", None, 0, None)], "component int, status string, edits array<string>, n_edits int, reasons array<string>")
    targets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "component int, target string")
    asked = []
    good = rename.after_compile(planned, targets, lambda names: asked.append(names))
    assert asked == [["a", "b"]] and [r["status"] for r in good.collect()] == ["ok", "StaleIndex"]
    bad = {r["component"]: r for r in rename.after_compile(planned, targets, lambda names: "no").collect()}
    assert bad[1]["status"] == "CompileFailed" and bad[1]["edits"] is None and bad[1]["reasons"] == ["no"] and bad[2]["status"] == "StaleIndex"


class Quiet:
    id = "quiet"


class Options:
    id = "options"

    def initialize(self, settings):
        self.more = settings["more"]

    def patch_options(self, target, options):
        return [*options, self.more]

    def filter_diagnostics(self, cursors, rows):
        raise RuntimeError("no")

    def synthetic_sources(self, target):
        return None


def test_hooks_fold_and_fail_alone():
    plugins = Plugins()
    plugins.load(["tests.test_workspace:Quiet", "tests.test_workspace:Options", "tests.test_workspace:Missing"], {"more": "-x"})
    assert [p.id for p in plugins.active] == ["quiet", "options"] and list(plugins.disabled) == ["tests.test_workspace:Missing"]
    assert plugins.fold("patch_options", ["-a"], "t") == ["-a", "-x"] and plugins.sources("t") == []
    assert plugins.fold("filter_diagnostics", "rows", None) == "rows" and plugins.disabled["options"].startswith("RuntimeError")
    assert plugins.fold("patch_options", ["-a"], "t") == ["-a"]
