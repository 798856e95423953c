"""Registered queries over the driver tables, each with a DuckDB oracle SQL."""

from supplylens.plans.registry import REGISTRY, queries, oracle_sql, register

__all__ = ["REGISTRY", "queries", "oracle_sql", "register"]
