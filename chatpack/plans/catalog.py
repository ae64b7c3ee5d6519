"""Named queries over the driver tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatpack.plans import chat_queries, math_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = chat_queries.QUERIES | math_queries.QUERIES
ORACLE_SQL: dict[str, str] = chat_queries.ORACLE_SQL | math_queries.ORACLE_SQL
