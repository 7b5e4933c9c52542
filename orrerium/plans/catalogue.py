"""Queries of the catalogue operators by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrerium.plans import audit_queries, case_queries, context_queries, gap_queries, node_queries, source_queries

FAMILIES = (gap_queries, audit_queries, case_queries, node_queries, context_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
