"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FAMILIES = ("window_queries", "detector_queries", "alert_queries", "join_queries", "evaluation_queries", "text_queries", "format_queries", "protocol_queries", "view_queries", "corpus_queries", "observation_queries", "stream_queries", "registry_queries", "order_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL for the same rows where there is any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for family in FAMILIES:
    import_module(f"taplight.plans.{family}")
