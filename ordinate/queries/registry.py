"""All queries, by name."""

from __future__ import annotations

from ordinate.queries import aggregates, positional, relational, structural
from ordinate.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "positional", "relational", "structural"]
