"""Registration of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertweft.plans.adapters import Lake, with_views
from alertweft.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(lake)`` under ``name``.

    ``views`` lists the adapter views the SQL twin needs; no ``sql`` means the
    result has no SQL form and is covered by a test instead.
    """

    def register(fn: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Lake(prepare(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = with_views(views.split(), sql)
        return fn

    return register
