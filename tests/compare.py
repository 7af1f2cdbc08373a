"""Compares a Spark result with DuckDB's on the same tables, regardless of row order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return repr(value) if not math.isnan(value) else "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def _key(value):
    return (type(value).__name__, value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    rows = df.collect()
    return sorted(df.columns), normal([tuple(r) for r in rows], df.columns)


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), normal(cursor.fetchall(), columns)


def spark_kinds(df):
    kinds = {"int": "int", "bigint": "bigint", "double": "double", "string": "string",
             "boolean": "boolean"}
    return {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}


def duck_kinds(connection, sql):
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
             "BOOLEAN": "boolean"}
    rows = connection.execute(f"DESCRIBE {sql}").fetchall()
    return {r[0]: kinds.get(str(r[1]), str(r[1])) for r in rows}
