"""Compare a Spark result with a DuckDB result: columns by name, rows as a bag of values."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return repr(value)
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both results hold the same columns and the same rows."""
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(df.columns) != sorted(expected_names):
        return [f"columns differ: {sorted(df.columns)} / {sorted(expected_names)}"]
    actual = _bag(df.collect(), df.columns)
    expected = _bag(expected_rows, expected_names)
    if actual == expected:
        return []
    lost, added = list((expected - actual).items()), list((actual - expected).items())
    return [
        f"{sum(actual.values())} rows, expected {sum(expected.values())}",
        *[f"missing {r}" for r in lost[:2]],
        *[f"unexpected {r}" for r in added[:2]],
    ]
