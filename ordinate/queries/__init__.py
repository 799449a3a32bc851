"""Queries on the standard tables with the SQL that gives the same rows."""

from ordinate.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
