"""Compare a registered query with its DuckDB twin."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(canon(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canon(x)) for k, x in value.items()))
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None where rows and values are equal, else a short text on the difference."""
    df = fn(spark, sf_dir)
    cols, got = sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    cur = con.execute(sql)
    want_cols, want = sorted_rows([c[0] for c in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"{name}: columns {cols} against {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows against {len(want)}"
    if not got:
        return f"{name}: no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{name}: {len(bad)} of {len(got)} rows differ, cols {cols}, first {bad[0]}"
    for a, b in zip(got[:50], want[:50]):
        kinds = [(c, type(x), type(y)) for c, x, y in zip(cols, a, b) if x is not None and y is not None and type(x) is not type(y)]
        if kinds:
            return f"{name}: types {kinds}"
    return None
