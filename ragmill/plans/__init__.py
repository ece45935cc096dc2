"""Registered queries over the given tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = (
    "retrieval evaluation warehouse ingest chunking names reports textclean scoring apps streams"
).split()


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = plain(oracle)
        return fn

    return add


def plain(text: str) -> str:
    """``{table}`` marks of the shared SQL fragments as bare names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"ragmill.plans.{name}")
