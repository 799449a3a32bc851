"""Terminals: where a query runs and its result comes to the driver."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions.selectors import Selector, one, truth
from ordinate.plans.position import ordering


class Terminals:
    def __init__(self, seq):
        self.seq = seq

    def list(self) -> list:
        """The items in order: rows, or plain values of a single column."""
        rows = self.seq.ordered_df.collect()
        return [r[0] for r in rows] if len(self.seq.columns) == 1 else rows

    def array(self):
        """A NumPy array of a single column, or of rows."""
        a = self.seq.ordered_df.toPandas().to_numpy()
        return a[:, 0] if len(self.seq.columns) == 1 else a

    def set(self) -> set:
        rows = self.seq.df.distinct().collect()
        return {r[0] for r in rows} if len(self.seq.columns) == 1 else set(rows)

    def entries(self, key: Selector, value: Selector = None) -> DataFrame:
        """(key, value) with the last item's value for each key."""
        seq, at = self.seq.positioned("dict")
        return seq._df.groupBy(one(key, seq.row()).alias("key")).agg(F.max_by(one(value, seq.row()), at).alias("value"))

    def dict(self, key: Selector, value: Selector = None) -> dict:
        return {r["key"]: r["value"] for r in self.entries(key, value).collect()}

    def pandas(self):
        """A Series of the first column."""
        return self.df()[self.seq.columns[0]]

    def df(self):
        """A pandas DataFrame in order."""
        return self.seq.ordered_df.toPandas()

    def _filtered(self, predicate: Selector):
        return self.seq if predicate is None else self.seq.where(predicate)

    def count(self, predicate: Selector = None) -> int:
        return self._filtered(predicate).df.count()

    def any(self, predicate: Selector = None) -> bool:
        return not self._filtered(predicate).df.isEmpty()

    def all(self, predicate: Selector) -> bool:
        return self.seq._df.where(~truth(predicate, self.seq.row())).isEmpty()

    def first_df(self, predicate: Selector = None, rows: int = 1) -> DataFrame:
        seq = self._filtered(predicate)
        seq.need_order("first")
        return seq._df.orderBy(*ordering(seq.keys)).limit(rows).select(*[F.col(f"`{c}`") for c in seq.columns])

    def _plain(self, row):
        return row[0] if len(self.seq.columns) == 1 else row

    def first(self, predicate: Selector = None):
        rows = self.first_df(predicate).collect()
        if not rows:
            raise ValueError("no element satisfies the condition" if predicate is not None else "sequence contains no elements")
        return self._plain(rows[0])

    def first_or_default(self, predicate: Selector = None, default: Any = None):
        rows = self.first_df(predicate).collect()
        return self._plain(rows[0]) if rows else default

    def single(self, predicate: Selector = None):
        """The only item; none or several are errors."""
        rows = self._filtered(predicate).df.limit(2).collect()
        if not rows:
            raise ValueError("no element satisfies the condition" if predicate is not None else "sequence contains no elements")
        if len(rows) > 1:
            raise ValueError("sequence contains more than one matching element")
        return self._plain(rows[0])

    def fold(self, accumulator: Callable[[Column, Column], Column] | str, seed: Any = None, finish: Callable[[Column], Column] | None = None, selector: Selector = None) -> DataFrame:
        """One row (value).  ``sum``, ``min``, ``max`` and ``product`` are added up in parallel; any other fold is
        sequential by nature and runs over one array in order."""
        value = one(selector, self.seq.row())
        if isinstance(accumulator, str):
            made = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}[accumulator](value)
            if seed is not None:
                made = {"sum": lambda c: F.coalesce(c + seed, F.lit(seed)), "product": lambda c: F.coalesce(c * seed, F.lit(seed)), "min": lambda c: F.least(c, F.lit(seed)), "max": lambda c: F.greatest(c, F.lit(seed))}[accumulator](made)
            return self.seq._df.agg((finish(made) if finish else made).alias("value"))
        from ordinate.operators.grouping import in_order

        seq, at = self.seq.positioned("aggregate")
        value = one(selector, seq.row())
        kind = seq._df.select(value.alias("v")).schema["v"].dataType
        whole = seq._df.agg(in_order(at, value).alias("a"))
        start = F.lit(seed) if seed is not None else F.try_element_at("a", F.lit(1))
        rest = F.col("a") if seed is not None else F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))
        start_kind = whole.select(start.alias("s")).schema["s"].dataType if seed is not None else kind
        made = F.aggregate(rest, start, lambda s, x: accumulator(s, x).cast(start_kind))
        return whole.select((finish(made) if finish else made).alias("value"))

    def aggregate(self, accumulator, seed: Any = None, selector: Selector = None):
        if seed is None and self.seq.df.isEmpty():
            raise ValueError("empty sequence and no seed")
        return self.fold(accumulator, seed, None, selector).first()[0]

    def aggregate_with_selector(self, seed: Any, accumulator, finish, selector: Selector = None):
        return self.fold(accumulator, seed, finish, selector).first()[0]
