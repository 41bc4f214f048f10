import random

from plumbline.streaming import folds, timed


def run(spark, tmp_path, rows, schema, fold, out, due, end):
    """The same events as a table, and as a stream of files in the given order."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = folds.batch(spark.createDataFrame(sorted(rows), schema), "uri", "at", fold, out, end)
    last = max(r[1] for r in rows) + 10_000_000
    parts = [rows[k : k + 25] for k in range(0, len(rows), 25)] + [[("~", last + k, last + k, "none", False)] for k in range(2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    found = timed.ordered(stream, "uri", fold, out, "400 seconds", due, end)
    query = found.writeStream.format("memory").queryName(f"timed_{abs(hash(str(tmp_path)))}").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    spark.conf.unset(provider)
    assert query.exception() is None
    got = [tuple(r) for r in spark.table(query.name).collect()]
    return sorted(tuple(r) for r in table.collect()), sorted(got)


def test_pulls_and_builds_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(9)
    events = [(f"u{rng.randrange(4)}", at, at, rng.choice(["change", "change", "save", "close"]), rng.random() < 0.3) for at in sorted(rng.sample(range(1_000_000, 1_300_000), 100))]
    rng.shuffle(events)  # all within the watermark's delay
    schema = "uri string, at long, seq long, kind string, compile boolean"
    window = 5000
    want, got = run(spark, tmp_path / "pulls", events, schema, folds.pull_fold(window), "armed long, due long", lambda s: None if s is None else s["armed"] + window, folds.pull_end(window))
    assert want and got == want
    want, got = run(spark, tmp_path / "builds", events, schema, folds.debounce_fold(window), "opened long, n long, compile_first boolean", lambda s: None if s is None else s["opened"] + window, folds.debounce_end)
    assert want and [g for g in got if g[0] != "~"] == want
