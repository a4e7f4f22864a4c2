"""Runs a query and its SQL on the same tables and compares the rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want = rows(names, want.fetchall())
    df = run(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
    return sum(got.values())
