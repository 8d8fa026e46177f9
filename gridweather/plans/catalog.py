"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from gridweather.plans.registry import ORACLES, QUERIES

MODULES = [
    "scalar_queries",
    "lookup_queries",
    "metric_queries",
    "series_queries",
    "table_queries",
    "sample_queries",
    "source_queries",
    "model_queries",
    "stream_queries",
]


def _load() -> None:
    for name in MODULES:
        import_module(f"gridweather.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
