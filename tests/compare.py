"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'").fetchall()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        ).fetchall()
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_result(connection, sql):
    cursor = connection.cursor()
    cursor.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    cursor.close()
    return canonical(columns, rows), types


FAMILIES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def difference(df, connection, sql) -> str | None:
    """None if the rows are equal, otherwise what differs first."""
    (wanted_names, wanted), types = sql_result(connection, sql)
    names, rows = spark_result(df)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    for name, dtype in df.dtypes:
        family = FAMILIES.get(dtype)
        if family and types[name] != family:
            return f"type of {name}: {dtype} != {types[name]}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows != {len(wanted)}; extra {[r for r in rows if r not in wanted][:2]} missing {[r for r in wanted if r not in rows][:2]}"
    for mine, other in zip(rows, wanted):
        if mine != other:
            detail = [(n, a, b) for n, a, b in zip(names, mine, other) if a != b]
            return f"values {detail[:3]} in {str(mine)[:300]}"
    return None
