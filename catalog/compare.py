"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str):
    connection = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(folder, "*.parquet"))):
        table = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x

    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, folder: str, connection, query, sql: str) -> str | None:
    """None if both sides give the same columns and rows, else a short account of what differs."""
    df = query(spark, folder)
    cursor = connection.execute(sql)
    names = [x[0] for x in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, cursor.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours: {list((ours - theirs).items())[:2]}; "
        f"only theirs: {list((theirs - ours).items())[:2]}"
    )
