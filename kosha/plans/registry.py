"""All queries of the analytics library with their DuckDB oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register a query callable (spark, sf_dir) -> DataFrame and, where one exists, its SQL oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"kosha.plans.{name}")


MODULES = ("series_queries", "technical_queries", "factor_queries", "catalog_queries", "finance_queries", "ops_queries", "portfolio_queries", "fundamental_queries", "document_queries", "matching_queries", "nested_queries", "audit_queries", "sheet_queries", "statement_queries", "holding_queries", "screen_queries")
