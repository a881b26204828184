"""Registered queries: every operator on the driver's tables, next to its DuckDB twin."""

from catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
