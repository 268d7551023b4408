"""Queries over the driver's tables, with the DuckDB SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import document_queries, entity_queries, record_queries, retrieval_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **document_queries.QUERIES, **entity_queries.QUERIES, **record_queries.QUERIES, **retrieval_queries.QUERIES
}
ORACLE_SQL: dict[str, str] = {
    **document_queries.ORACLE_SQL, **entity_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **retrieval_queries.ORACLE_SQL
}
