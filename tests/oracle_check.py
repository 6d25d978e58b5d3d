"""Compare registered queries with their SQL on one folder of test tables."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def cell(value):
    """A value as text that compares across both engines."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime):
        return value.isoformat()
    return f"{type(value).__name__} {value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


SAME_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def compare(df, connection, sql: str) -> tuple[int, list[str]]:
    """Number of Spark rows and what differs: names, types, row count, values."""
    problems = []
    answer = connection.execute(sql)
    names = [c[0] for c in answer.description]
    expected = answer.fetchall()
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} against {sorted(names)}")
        return 0, problems
    kinds = {c[0]: str(c[1]) for c in connection.execute(f"describe {sql}").fetchall()}
    for name, kind in df.dtypes:
        if SAME_KIND.get(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    found = df.collect()
    left, right = rows_of(df.columns, found), rows_of(names, expected)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows against {len(right)}")
    if left != right:
        only_left = [r for r in left[:2000] if r not in set(right)][:2]
        only_right = [r for r in right[:2000] if r not in set(left)][:2]
        problems.append(f"values: Spark only {only_left}, SQL only {only_right}")
    return len(found), problems
