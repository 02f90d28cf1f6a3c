"""Compare a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def family(kind: str) -> str:
    kind = kind.lower()
    for ours, names in {
        "int": ("int", "integer"),
        "bigint": ("bigint",),
        "double": ("double",),
        "string": ("string", "varchar"),
        "boolean": ("boolean",),
    }.items():
        if kind in names:
            return ours
    return kind


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text, empty when the results agree in columns, types and rows."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: family(str(d[1])) for d in cursor.description}
    expected = rows_of(columns, cursor.fetchall())
    found_kinds = {name: family(kind) for name, kind in spark_df.dtypes}
    problems = []
    if found_kinds != kinds:
        problems.append(f"columns {found_kinds} != {kinds}")
    if sorted(found_kinds) != sorted(kinds):
        return problems
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} != {len(expected)}")
    if found != expected:
        diff = [(a, b) for a, b in zip(found, expected) if a != b][:2]
        problems.append(f"values differ: {diff}")
    return problems
