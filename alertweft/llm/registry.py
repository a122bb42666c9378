"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertweft.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; without ``sql`` a brute-force test covers it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def load_queries():
    """Import the query modules once and return (queries, twins)."""
    from alertweft.llm import queries

    for module in sorted(m.name for m in pkgutil.iter_modules(queries.__path__)):
        importlib.import_module(f"{queries.__name__}.{module}")
    return QUERIES, TWINS
