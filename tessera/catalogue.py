"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import access_queries, context_queries, conversation_queries, document_queries, ingest_queries, lifecycle_queries, search_queries, store_queries, stream_queries

FAMILIES = [access_queries, context_queries, conversation_queries, document_queries, ingest_queries, lifecycle_queries, search_queries, store_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
