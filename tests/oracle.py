"""Compares a query's rows with those of its SQL, whatever their order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("LOOMGRAPH_TESTDATA", "/root/testdata/sf0.001")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def oracle_rows(sql: str, directory: str = DATA) -> tuple[list[str], list[tuple[str, ...]]]:
    with duckdb.connect() as connection:
        for table in TABLES:
            if os.path.exists(path := f"{directory}/{table}.parquet"):
                connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        found = connection.sql(sql)
        return sorted(found.columns), rows_of(found.columns, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())
