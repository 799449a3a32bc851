"""A selector is a Column, a column name, or a callable from a row to a Column or a dict of Columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Selector = Any


class Row:
    """Stands for a sequence's item: attributes and keys are its columns."""

    def __init__(self, columns: dict[str, Column]):
        object.__setattr__(self, "_columns", columns)

    def __getitem__(self, name: str) -> Column:
        try:
            return self._columns[name]
        except KeyError:
            raise KeyError(f"no column {name!r}; there are {', '.join(self._columns)}") from None

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def item(self) -> Column:
        """The whole item: a struct, or the one column's value."""
        if len(self._columns) == 1:
            return next(iter(self._columns.values()))
        return F.struct(*[c.alias(n) for n, c in self._columns.items()])


def one(selector: Selector, *rows: Row) -> Column:
    """The selector's single value."""
    if selector is None:
        return rows[0].item()
    if isinstance(selector, str):
        return rows[0][selector]
    if callable(selector) and not isinstance(selector, Column):
        return one(selector(*rows), *rows)
    if isinstance(selector, dict):
        return F.struct(*[as_column(v).alias(k) for k, v in selector.items()])
    return as_column(selector)


def many(selector: Selector, *rows: Row) -> dict[str, Column]:
    """The selector's columns by name; a single value is ``value``."""
    if isinstance(selector, str):
        return {selector: rows[0][selector]}
    if callable(selector) and not isinstance(selector, Column):
        return many(selector(*rows), *rows)
    if isinstance(selector, dict):
        return {k: as_column(v) for k, v in selector.items()}
    if isinstance(selector, (list, tuple)):
        return {s: rows[0][s] for s in selector}
    return {"value": as_column(selector)}


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def truth(predicate: Selector, *rows: Row) -> Column:
    """A predicate's truth: numbers count when not zero, null is false."""
    return F.coalesce(one(predicate, *rows).cast("boolean"), F.lit(False))


Aggregator = Callable[[Column], Column]
