"""Runs a registered query in Spark and its SQL in DuckDB and compares names, types' families and all values."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def family(value) -> str:
    kinds = {bool: "bool", int: "int", float: "float", decimal.Decimal: "decimal", str: "str"}
    kinds |= {datetime.date: "date", datetime.datetime: "timestamp", type(None): "null"}
    return kinds[type(value)]


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple((family(r[i]), str(r[i])) for i in order) for r in rows))


def differences(df, con, sql: str) -> list[str]:
    relation = con.execute(sql)
    duck_names = [d[0] for d in relation.description]
    expected = rows_of(duck_names, relation.fetchall())
    got = rows_of(df.columns, df.collect())
    found = []
    if df.columns != duck_names:
        found.append(f"columns {df.columns} != {duck_names}")
    if len(got) != len(expected):
        found.append(f"{len(got)} rows != {len(expected)}")
    for g, e in zip(got, expected):
        if g != e:
            found.append(f"{g}\n  != {e}")
    return found
