"""Runs a query beside its SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(value: object) -> str:
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)) or type(value).__module__ == "decimal":
        return f"{float(value):.9g}"
    if type(value).__module__ == "numpy":
        return plain(value.tolist()) if hasattr(value, "tolist") else str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(plain, value)) + "]"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows(columns: list[str], data: list) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


def differences(query, sql: str, spark, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    result = con.sql(sql)
    theirs = rows(result.columns, result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] == theirs[1]:
        return ""
    a, b = set(ours[1]), set(theirs[1])
    return f"{len(ours[1])} and {len(theirs[1])} rows; only ours {sorted(a - b)[:4]}, only theirs {sorted(b - a)[:4]}"
