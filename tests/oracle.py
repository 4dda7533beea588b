"""Compares a query with its SQL, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value) if float(value).is_integer() and abs(value) < 1e17 else f"{value:.11g}"
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, run, sql: str, sf_dir: str) -> None:
    frame = run(spark, sf_dir)
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(names, cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
