"""Driver queries: every operator over views of the driver's tables, with the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the same question for DuckDB."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


MODULES = ["scans", "snapshots", "joins", "aggregates", "ranking", "scalars", "entities", "series",
           "sky", "reports"]


def load() -> tuple[dict, dict]:
    """All registered queries and oracles."""
    for module in MODULES:
        import_module(f"starledger.registry.{module}")
    return QUERIES, ORACLES
