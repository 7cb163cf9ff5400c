"""Runs registered queries beside their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.date() if x.time() == datetime.time() else x
    return x


def key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=key)


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    theirs = rows_of([c[0] for c in res.description], res.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} and {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"{len(ours[1])} and {len(theirs[1])} rows", str(ours[1][:2]), str(theirs[1][:2])]
    bad = [(a, b) for a, b in zip(*(ours[1], theirs[1]), strict=True) if a != b]
    return [f"{len(bad)} of {len(ours[1])} rows differ: {bad[0]}"] if bad else [] if ours[1] else ["no rows"]


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
