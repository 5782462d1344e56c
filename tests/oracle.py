"""Runs a query's SQL in DuckDB and compares rows."""

import glob
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _sorted(rows):
    return sorted((tuple(map(_norm, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same_rows(df, sql: str, folder: str) -> None:
    columns = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == _sorted(tuple(r[i] for i in at) for r in result.fetchall())
