"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return int(v) if isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert len(got) > 0
    assert [tuple(map(str, r)) for r in rows(df.columns, got)] == [tuple(map(str, r)) for r in rows(names, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in found.fetchall()])]
