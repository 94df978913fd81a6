"""Run a registered query and its SQL twin, and compare the tables as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def _multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows under the same column names, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected_rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns: {sorted(df.columns)} vs {sorted(names)}"
    got_rows = df.collect()
    got, expected = _multiset(df.columns, got_rows), _multiset(names, expected_rows)
    if got == expected:
        return None
    types = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields]
    return (
        f"{len(got_rows)} vs {len(expected_rows)} rows; {types}; "
        f"only spark: {list((got - expected).items())[:2]}; only sql: {list((expected - got).items())[:2]}"
    )
