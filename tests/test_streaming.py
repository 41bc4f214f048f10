import json
import random


from plumbline.streaming import folds


def test_ranged_edits_in_utf16_columns():
    e = lambda sl, sc, el, ec, t: {"sl": sl, "sc": sc, "el": el, "ec": ec, "text": t}
    assert folds.apply_edits("ab\ncd", [e(0, 1, 1, 1, "X")]) == "aXd"
    assert folds.apply_edits("😀b", [e(0, 2, 0, 3, "c")]) == "😀c"
    assert folds.apply_edits("😀b", [e(0, 1, 0, 2, "")]) == "b"
    assert folds.apply_edits("abc", [e(0, 2, 0, 1, "-"), e(9, 0, 9, 9, "!")]) == "a-c!"
    assert folds.apply_edits("a\r\nb", [e(0, 99, 0, 99, "z")]) == "az\r\nb"
    assert folds.apply_edits("abc", [{"text": "new"}, e(0, 0, 0, 1, "N")]) == "New"


def events(rng, n=300):
    return [(f"u{rng.randrange(6)}", i, rng.choice("abc"), rng.random() < 0.4, json.dumps([f"m{i}"] * rng.choice([0, 1, 2]))) for i in range(n)]


def slow_router(rows):
    lists, shown, out = {}, set(), []
    for uri, seq, target, reset, messages in rows:
        own, new = lists.setdefault(uri, {}), json.loads(messages)
        if reset and not new:
            own.pop(target, None)
        elif reset:
            own[target] = new
        else:
            own[target] = own.get(target, []) + new
        union = sum(own.values(), [])
        if union:
            shown.add(uri)
            out.append((uri, seq, json.dumps(union)))
        else:
            lists.pop(uri)
            if uri in shown:
                shown.discard(uri)
                out.append((uri, seq, "[]"))
    return sorted(out)


SCHEMA = "uri string, seq long, target string, reset boolean, messages string"
OUT = "seq long, diagnostics string"


def test_router_equals_brute_force(spark):
    rows = events(random.Random(3))
    got = folds.batch(spark.createDataFrame(rows, SCHEMA).repartition(5), "uri", "seq", folds.router_fold, OUT).collect()
    assert sorted(map(tuple, got)) == slow_router(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = events(random.Random(5))
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = folds.stream(source, "uri", "seq", folds.router_fold, OUT)
    run = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert run.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == slow_router(rows)


def test_windows_are_fixed_and_not_extended(spark):
    rows = [("a", i, t, c) for i, (t, c) in enumerate([(0, False), (400, True), (499, False), (500, False), (900, False), (1001, True)])] + [("b", 1, 7, False)]
    df = spark.createDataFrame(rows, "uri string, seq long, at long, compile boolean")
    got = folds.batch(df, "uri", "seq", folds.debounce_fold(500), "opened long, n long, compile_first boolean", folds.debounce_end).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 3, True), ("a", 500, 2, False), ("a", 1001, 1, True), ("b", 7, 1, False)]


def test_buffers():
    state, out = folds.buffer_fold(None, {"kind": "change", "seq": 1, "version": 1, "edits": '[{"sl":0,"sc":0,"el":0,"ec":0,"text":"x"}]'})
    assert state is None and out == []
    state, _ = folds.buffer_fold(None, {"kind": "open", "seq": 2, "version": 3, "edits": '[{"text":"ab"}]'})
    state, out = folds.buffer_fold(state, {"kind": "change", "seq": 3, "version": 2, "edits": '[{"sl":0,"sc":1,"el":0,"ec":2,"text":"c"}]'})
    assert out == [(3, 2, "ac")]
    assert folds.buffer_fold(state, {"kind": "close", "seq": 4, "version": 0, "edits": None}) == (None, [(4, None, None)])
