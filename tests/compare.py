"""Compare a Spark result with its SQL twin, order-insensitively and by column name."""

from __future__ import annotations

import math

import duckdb

from voxtable.schemas import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}")
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(body, key=repr)


def spark_rows(df):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return *rows_of(df.columns, [tuple(r) for r in df.collect()]), kinds


def duck_rows(con, sql):
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return *rows_of([d[0] for d in cur.description], cur.fetchall()), kinds


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cols_a, a, kinds_a = spark_rows(df)
    cols_b, b, kinds_b = duck_rows(con, sql)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    bad = {c: (kinds_a[c], kinds_b[c]) for c in cols_a if TYPES.get(kinds_a[c]) != kinds_b[c]}
    if bad:
        return f"types {bad}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; only spark {sorted(set(a) - set(b), key=repr)[:3]}; only sql {sorted(set(b) - set(a), key=repr)[:3]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{cols_a}: {x} != {y}"
    return None
