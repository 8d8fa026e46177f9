"""Registry of queries and of their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweather import session
from gridweather.sources.views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its twin over the same tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(session.prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return run

    return register


def with_views(body: str) -> str:
    """Put every fixture view the text names in front of it as a CTE."""
    needed = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    body = body.strip()
    if not needed:
        return body
    head = ",\n".join(f"{v} as ({VIEW_SQL[v]})" for v in needed)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def nudge(digits: int) -> float:
    """Added before rounding, so that a decimal tie goes the same way in both engines whatever the order of a sum."""
    return float(f"3e-{digits + 4}")


def r(expr: str, digits: int = 6) -> str:
    """Rounded double in SQL without a negative zero."""
    x = f"({expr} + {nudge(digits)!r})"
    return f"(case when abs({x}) < 5e-{digits + 1} then 0e0 else round({x}, {digits}) end)"


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Twin of ``r``."""
    return F.round((col if isinstance(col, Column) else F.col(col)) + nudge(digits), digits)


def h(seed: str, ident: str) -> str:
    """SQL twin of ``functions.hashing.h``; both arguments are SQL expressions."""
    return f"cast('0x' || substring(md5(concat({seed}, '|', {ident})), 1, 15) as bigint)"


def u01(seed: str, ident: str) -> str:
    return f"(cast({h(seed, ident)} as double) / 1152921504606846976e0)"
