"""Run a registered query and its DuckDB equivalent and compare them as multisets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_by_name(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = sorted(tuple(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], table


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise a short description of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    want_cols, want = rows_by_name(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} duckdb {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    return ""
