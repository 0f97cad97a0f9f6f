"""Compare a registered query with its SQL, value by value and type by type."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


def oracle_rows(sql: str, sf_dir: str):
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        result = db.execute(sql)
        columns = [(d[0], TYPES.get(str(d[1]), str(d[1]))) for d in result.description]
        return columns, result.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise a short account of what differs."""
    columns, expected = oracle_rows(sql, sf_dir)
    actual = df.collect()
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    if schema != sorted(columns):
        return f"schema {schema} against {sorted(columns)}"
    if not actual:
        return "no rows"
    left = _bag(df.columns, actual)
    right = _bag([name for name, _ in columns], expected)
    if left == right:
        return ""
    return (f"{len(actual)} rows against {len(expected)}; only here {list((left - right).items())[:3]}; "
            f"only there {list((right - left).items())[:3]}")
