"""Registered queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, code_queries, graph_queries, text_queries, trace_queries, vector_queries

_PARTS = (vector_queries, graph_queries, code_queries, text_queries, trace_queries, catalog_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
