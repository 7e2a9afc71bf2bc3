"""Compares a query with its SQL on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6f}"
    return str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def assert_same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = db.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert len(got) == len(want)
    assert rows(got, columns) == rows(want, columns)
