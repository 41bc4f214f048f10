import zlib
from collections import Counter, defaultdict

import xxhash

from plumbline.llm.queries import op2_sharding
from plumbline.llm.sharding import shard, splitters, write_shards


def brute(rows, shards=16):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, i, t or "") for i, t in rows)
    total, group, at = sum(k[2] for k in keyed), Counter(), 0
    for k in keyed:
        group[k[0]] += k[2]
    out, start, slots = [], {}, Counter()
    for h, _, size, i, t in keyed:
        start.setdefault(h, at)
        whole = group[h] <= int(0.01 * total / shards)
        a, e = (start[h], group[h]) if whole else (at, size)
        s = min(shards - 1, (2 * a + e) * shards // (2 * total))
        out.append((i, size, zlib.crc32(t.encode()), "bytes", s, slots[s], None))
        slots[s] += 1
        at += size
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_real_rows_match_brute_force(spark):
    got = [tuple(r) for r in op2_sharding(spark, "/root/testdata/sf0.001").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_hot_group_nulls_and_repeats(spark, tmp_path):
    rows = [(i, "the same text over and over") for i in range(3000)] + [(5000 + i, f"text {i} " * (i % 50)) for i in range(3000)]
    rows += [(None, None), (None, "x"), (7, None), (7, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "a", 4) for i, t in rows], "doc_id long, text string, h string, size int")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op2_sharding(spark, str(tmp_path)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    load = defaultdict(int)
    for r in got:
        load[r[4]] += r[1]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 16
    write_shards(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_splitters_cut_hot_keys_only():
    found = splitters([(1, 1, 1.0), (5, 1, 1.0), (5, 2, 1.0), (5, 3, 1.0), (8, 4, 1.0)], 5)
    assert found == sorted(found) and all(d == -(1 << 63) for h, d in found if h != 5) and len([1 for h, _ in found if h == 5]) == 3


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard(df).count() == 0


def test_very_long_text_and_clashing_columns(spark):
    rows = [(i, "word " * (i % 7)) for i in range(200)] + [(900, "long " * 400_000), (901, None), (901, None)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, h string, size int")
    assert sorted((tuple(r) for r in shard(df).collect()), key=key) == sorted(brute(rows), key=key)
