"""Run a named query on Spark and its SQL on DuckDB, as sorted lists of plain tuples."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda row: [(v is None, str(type(v)), v) for v in row])


def spark_rows(df):
    return _sorted(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(sql, folder):
    connection = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return _sorted(names, result.fetchall())
