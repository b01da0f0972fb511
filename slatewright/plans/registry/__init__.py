"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("evaluating", "neighbours", "preparation", "statistics", "embeddings",
           "combining", "texts", "sequencing", "streams", "storage", "running")


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
