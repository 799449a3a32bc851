"""Joins by position."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ordinate.functions.selectors import Selector, many
from ordinate.operators.joins import JoinOps


class ZipOps:
    def __init__(self, seq):
        self.seq = seq

    def _zip(self, other, result: Selector, how: str, default_self: Any = None, default_other: Any = None):
        (a, x), (b, y) = self.seq.positioned("zip"), other.positioned("zip")
        left, o, (lk,) = JoinOps._side(a, lambda r: F.col(x), "l")
        right, i, _ = JoinOps._side(b, lambda r: F.col(y), "r")
        joined = left.join(right, F.col("__lkey") == F.col("__rkey"), how)
        o, i = JoinOps._or(o, "__l", default_self), JoinOps._or(i, "__r", default_other)
        made = many(result, o, i) if result is not None else {**{f"left_{c}": v for c, v in o._columns.items()}, **{f"right_{c}": v for c, v in i._columns.items()}}
        df = joined.select(*[c.alias(n) for n, c in made.items()], F.coalesce("__lkey", "__rkey").alias(lk[0]))
        return self.seq.with_rows(df, list(made), [lk], 0)

    def zip_with(self, other, result: Selector = None):
        """Pairs by position, as many as the shorter has."""
        return self._zip(other, result, "inner")

    def zip_longest_with(self, other, result: Selector = None, default_self: Any = None, default_other: Any = None):
        """Pairs by position, as many as the longer has; defaults fill in, and a null item stays null."""
        return self._zip(other, result, "full", default_self, default_other)
