"""Registry of queries and of the SQL texts they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revgrain.plans.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, list[str]] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the views of ``tables`` by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        SURVEY_IDS[name] = ids.split()
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
