"""Compare a query with its SQL on one scale of the test tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    want = sorted(repr([plain(v) for v in r]) for r in rel.select(*cols).fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    assert len(want) == len(got)
    assert want == got
