"""Queries over the driver's tables by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groovemill.plans import album_queries, document_queries, graph_queries, lookup_queries, ranking_queries, taste_queries

_MODULES = (graph_queries, ranking_queries, album_queries, taste_queries, lookup_queries, document_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
