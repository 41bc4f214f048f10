import time

import pytest
from pyspark.sql import functions as F

from plumbline.plans import fact_queries
from plumbline.sources import fact_source, facts

DOCS = [
    {"uri": f"src/{k % 3}/D{k}.scala", "schema": 4, "language": 1, "text": "é" * k, "md5": f"M{k}", "symbols": [{"symbol": f"a/C{k}#", "kind": 13, "properties": 0, "display_name": "", "overridden_symbols": ["a/B#", "a/A#"][: k % 3]}],
     "occurrences": [{"symbol": f"a/C{k}#", "role": 2, "start_line": k, "start_character": 0, "end_line": k, "end_character": 300}, {"symbol": "x#", "role": 1, "start_line": None, "start_character": None, "end_line": None, "end_character": None}]}
    for k in range(20)
]


@pytest.fixture()
def ready(spark):
    fact_source.register(spark)
    schema = ", ".join(c for c in facts.SCHEMA.split(", ", 2)[2:])
    return spark, spark.createDataFrame([{k: d[k] for k in ("uri", "schema", "language", "text", "md5", "symbols", "occurrences")} for d in DOCS], schema)


@pytest.mark.parametrize("layout", ["uri", "parts"])
def test_documents_come_back(ready, tmp_path, layout):
    spark, df = ready
    df.repartition(4).write.format("facts").option("layout", layout).mode("append").save(f"{tmp_path}/x")
    got = spark.read.format("facts").option("layout", layout).option("bytes", 200).load(f"{tmp_path}/x")
    assert got.rdd.getNumPartitions() > 2
    assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert sorted(map(repr, facts.read_facts(spark, f"{tmp_path}/x").select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    df.limit(3).write.format("facts").option("layout", layout).mode("overwrite").save(f"{tmp_path}/x")
    assert spark.read.format("facts").load(f"{tmp_path}/x").count() == 3


def test_filters_on_the_uri_open_their_files_only(ready, tmp_path):
    spark, df = ready
    df.write.format("facts").option("layout", "uri").mode("append").save(str(tmp_path))
    (tmp_path / "src/1/bad.semanticdb").write_bytes(b"\x0a\xff\x01")
    read = spark.read.format("facts").option("layout", "uri").load(str(tmp_path))
    assert read.where("error is not null").select("path").count() == 1 and read.count() == 21
    assert [r["md5"] for r in read.where("uri = 'src/1/D4.scala'").collect()] == ["M4"]
    assert read.where(F.col("uri").isin("src/1/D4.scala", "src/2/D5.scala", "no") & F.col("uri").startswith("src/2")).count() == 1
    assert read.where("uri like 'src/0/%' and language = 1").count() == 7
    wanted = fact_source.FactReader({"path": str(tmp_path), "layout": "uri"})
    assert not list(wanted.pushFilters([fact_source.StringStartsWith(("uri",), "src/0/")]))
    assert sum(len(p.paths) for p in wanted.partitions()) == 7
    assert "EqualTo" in read.where("uri = 'x'")._jdf.queryExecution().executedPlan().toString() or read.where("uri = 'x'").count() == 0


def test_nothing_leads_out_of_the_folder(ready, tmp_path):
    spark, df = ready
    for uri in ("../x", "/x", ""):
        with pytest.raises(Exception, match="leads out"):
            df.limit(1).withColumn("uri", F.lit(uri)).write.format("facts").option("layout", "uri").mode("append").save(f"{tmp_path}/y")
    assert spark.read.format("facts").load(f"{tmp_path}/none").count() == 0


def test_the_stream_reads_what_changed(ready, tmp_path):
    spark, df = ready
    root = tmp_path / "in"
    df.where("md5 < 'M15'").write.format("facts").option("layout", "uri").mode("append").save(str(root))
    stream = spark.readStream.format("facts").option("settle", 0).load(str(root))
    query = stream.writeStream.format("memory").queryName("facts_seen").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()
        first = spark.table("facts_seen").count()
        time.sleep(0.05)
        df.where("md5 >= 'M15'").write.format("facts").option("layout", "uri").mode("append").save(str(root))
        query.processAllAvailable()
        assert 0 < first < 20 and sorted(r["md5"] for r in spark.table("facts_seen").collect()) == sorted(d["md5"] for d in DOCS)
    finally:
        query.stop()


def test_words_of_fact_documents_are_not_shuffled(spark):
    """Only texts are dealt, for the groups and for the join with them (F1)."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) uri", "lang", "text")
    tree = fact_queries.fact_documents(texts)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange ") == tree.count("REPARTITION_BY_NUM") == 2
