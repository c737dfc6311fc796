"""Run a query on Spark and its SQL on DuckDB and compare schema, row count and values."""

from __future__ import annotations

import math
import time

import duckdb

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0) if v else "0.0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description of the difference."""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "no SQL to compare with", took, len(rows)
    result = con.execute(sql)
    expected = table([d[0] for d in result.description], result.fetchall())
    actual = table(df.columns, rows)
    if actual[0] != expected[0]:
        return f"columns {actual[0]} != {expected[0]}", took, len(rows)
    if actual[1] != expected[1]:
        spark_only, sql_only = sorted(set(actual[1]) - set(expected[1]))[:4], sorted(set(expected[1]) - set(actual[1]))[:4]
        return (f"{len(actual[1])} / {len(expected[1])} rows of {actual[0]}; only spark {spark_only}; only sql {sql_only}"), took, len(rows)
    return None, took, len(rows)
