"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = table(rel.columns, rel.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
