"""Queries of the engine and their SQL, by name."""

from vecgrove.plans.queries import QUERIES
from vecgrove.plans.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
