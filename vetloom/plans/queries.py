"""The registered queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, library_queries, records_queries, review_queries, store_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**records_queries.QUERIES, **review_queries.QUERIES, **library_queries.QUERIES, **store_queries.QUERIES, **file_queries.QUERIES}
SQL: dict[str, str] = {**records_queries.SQL, **review_queries.SQL, **library_queries.SQL, **store_queries.SQL, **file_queries.SQL}
