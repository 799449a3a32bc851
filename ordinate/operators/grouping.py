"""Grouping, pivots and windows over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions.selectors import Selector, many, one, truth
from ordinate.plans.position import in_windows, running


def in_order(position: str, item: Column) -> Column:
    """An aggregate: the group's items in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


class GroupOps:
    def __init__(self, seq):
        self.seq = seq

    def group_by(self, selector: Selector):
        """One item for each key: the key's columns and ``items``, keys in order of appearance.

        A group becomes one array; where groups may be large, use
        group_by_with_aggregate, which adds up before it moves rows.
        """
        seq, at = self.seq.positioned("group_by")
        keys = many(selector, seq.row())
        keys = {("key" if n == "value" else n): c for n, c in keys.items()}
        df = seq._df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(in_order(at, seq.item()).alias("items"), F.min(at).alias(at))
        return seq.with_rows(df, [*keys, "items"])

    def group_by_multiple(self, *selectors: Selector, **aggregates):
        """Groups by several keys, ``key1``, ``key2`` or by name; without any, one group of all.

        With aggregates (name -> function from the item to an aggregate) these
        instead of ``items``: they add up before rows move, so a group may have
        any size.
        """
        row = self.seq.row()
        keys = {(s if isinstance(s, str) else f"key{k}"): one(s, row) for k, s in enumerate(selectors, 1)}
        if keys:
            return self.group_by_with_aggregate(lambda r: keys, None, **aggregates) if aggregates else self.group_by(lambda r: keys)
        if aggregates:
            some = F.count(F.lit(1)).alias("__some")
            df = self.seq._df.agg(*[f(row).alias(n) for n, f in aggregates.items()], some).where("__some > 0")
            return self._keyed(df, "__some", list(aggregates))
        seq, at = self.seq.positioned("group_by_multiple")
        df = seq._df.groupBy().agg(in_order(at, seq.item()).alias("items"), F.min(at).alias(at)).where(F.col(at).isNotNull())
        return seq.with_rows(df, ["items"])

    def group_by_with_aggregate(self, key: Selector, element: Selector, **aggregates):
        """One item for each key with aggregates of its elements; name -> function from the element to an aggregate."""
        row = self.seq.row()
        keys = {("key" if n == "value" else n): c for n, c in many(key, row).items()}
        value = None if element is None else one(element, row)
        made = [f(row if value is None else value).alias(n) for n, f in aggregates.items()]
        first = [F.min(F.struct(*[n for n, _ in self.seq.keys])).alias("__first")] if self.seq.keys and not any(d for _, d in self.seq.keys) else []
        df = self.seq._df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*made, *first)
        order = [("__first", False)] if first else [(n, False) for n in keys]
        if first:
            from ordinate.seq import hidden

            name = hidden()
            df, order = df.withColumnRenamed("__first", name), [(name, False)]
        else:  # keys are unique
            from ordinate.seq import hidden

            names = {n: hidden() for n in keys}
            df, order = df.withColumns({h: F.col(n) for n, h in names.items()}), [(h, False) for h in names.values()]
        return self.seq.with_rows(df, [*keys, *aggregates], order, 0)

    def pivot(self, row: Selector, column: Selector, aggregate, values: list | None = None):
        """Cells that occur, as (row, column, value); with ``values``, one column for each of them (null: no such cell)."""
        r = self.seq.row()
        a, b = one(row, r).alias("row"), one(column, r).alias("column")
        if values is None:
            df = self.seq._df.groupBy(a, b).agg(aggregate(r).alias("value"))
            return type(self.seq).of(df, ["row", "column"])
        return type(self.seq).of(self.seq._df.select("*", a, b).groupBy("row").pivot("column", values).agg(aggregate(r)), ["row"])

    def group_by_nested(self, selector: Selector, sub_selector: Selector, **aggregates):
        """Groups in groups, as (key, sub_key, items), or with aggregates instead of ``items`` as in group_by_multiple."""
        row = self.seq.row()
        keys = {"key": one(selector, row), "sub_key": one(sub_selector, row)}
        return self.group_by_with_aggregate(lambda r: keys, None, **aggregates) if aggregates else self.group_by(lambda r: keys)

    def partition(self, predicate: Selector):
        """Items for which the predicate holds, and the others; null doesn't hold."""
        t = truth(predicate, self.seq.row())
        return self.seq.with_rows(self.seq._df.where(t)), self.seq.with_rows(self.seq._df.where(~t))

    def chunk(self, size: int):
        """Arrays ``items`` of ``size`` items, the last may be shorter."""
        if size <= 0:
            raise ValueError("chunk size must be positive")
        seq, at = self.seq.positioned("chunk")
        df = seq._df.groupBy(F.floor(F.col(at) / size).alias("__c")).agg(in_order(at, seq.item()).alias("items"))
        return self._keyed(df, "__c", ["items"])

    batched = chunk

    def _keyed(self, df: DataFrame, name: str, columns: list[str]):
        from ordinate.seq import hidden

        key = hidden()
        return self.seq.with_rows(df.withColumnRenamed(name, key), columns, [(key, False)], 0)

    def window(self, size: int):
        """Arrays ``items`` of each ``size`` consecutive items; none if there are fewer.  Size 0 gives an empty one before each item and after the last."""
        if size < 0:
            raise ValueError("window size must not be negative")
        seq, at = self.seq.positioned("window")
        if size == 0:
            empty = F.array().cast("array<int>").alias("items")
            df = seq._df.select(empty, F.col(at).alias("__w")).union(seq._df.agg(F.count("*").alias("__w")).select(empty, "__w"))
            return self._keyed(df, "__w", ["items"])
        df = in_windows(seq._df, at, 0, size - 1, {"items": lambda w: F.collect_list(F.struct(seq.item().alias("v"))).over(w.rowsBetween(0, size - 1))})
        df = df.where(F.size("items") == size).select(F.transform("items", lambda x: x["v"]).alias("items"), F.col(at).alias("__w"))
        return self._keyed(df, "__w", ["items"])

    def pairwise(self):
        """Structs ``first`` and ``second`` of neighbours."""
        seq, at = self.seq.positioned("pairwise")
        df = in_windows(seq._df, at, 0, 1, {"__n": lambda w: F.lead(F.struct(seq.item().alias("v")), 1).over(w)})
        df = df.where("__n is not null").select(seq.item().alias("first"), F.col("__n")["v"].alias("second"), F.col(at).alias("__w"))
        return self._keyed(df, "__w", ["first", "second"])

    def runs(self, selector: Selector = None) -> tuple[DataFrame, str]:
        """Rows with ``__run``, the number of their run of equal keys, and their position."""
        seq, at = self.seq.positioned("batch_by")
        key = F.struct(one(selector, seq.row()).alias("v"))
        changed = in_windows(seq._df, at, 1, 0, {"__new": lambda w: (~key.eqNullSafe(F.lag(key, 1).over(w))).cast("long")})
        return running(changed, at, {"__run": ("sum", F.col("__new"))}).drop("__new"), at

    def batch_by(self, selector: Selector):
        """Arrays ``items`` of consecutive items with equal keys, with the ``key``."""
        df, at = self.runs(selector)
        done = df.groupBy("__run").agg(F.min_by(one(selector, self.seq.row()), at).alias("key"), in_order(at, self.seq.item()).alias("items"))
        return self._keyed(done, "__run", ["key", "items"])
