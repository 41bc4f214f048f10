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
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)

    def plain(r):
        return repr([round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r])

    want = sorted(map(plain, rel.select(*(f'"{c}"' for c in cols)).fetchall()))
    got = sorted(map(plain, df.select(*cols).collect()))
    assert len(want) == len(got)
    assert want == got
