"""Runs a query on Spark and its SQL twin on DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def cell(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return [cell(v) for v in x]
    return x if isinstance(x, (int, bool, str, type(None))) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(row[i]) for i in order)) for row in data)


def compare(spark, query, sql, sf="sf0.001"):
    folder = f"{ROOT}/{sf}"
    df = query(spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    twin = con.sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(twin.columns, twin.fetchall())
