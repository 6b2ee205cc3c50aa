"""Operators for large training-data pipelines, and their queries."""

from sievegrid.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
