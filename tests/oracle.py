"""Runs a query's SQL in DuckDB and compares rows without regard to order."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    return value


def assert_equal(frame, sql: str, folder: str) -> int:
    got = connect(folder).execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(frame.columns) == sorted(names)
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in got.fetchall())
    ours = Counter(tuple(plain(row[c]) for c in sorted(names)) for row in frame.collect())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
