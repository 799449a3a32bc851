"""Equi-joins on keys; null matches null, output is in outer then inner order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ordinate.functions.selectors import Row, Selector, as_column, many, one


class JoinOps:
    def __init__(self, seq):
        self.seq = seq

    @staticmethod
    def _side(seq, selector: Selector, mark: str):
        """The side with all columns renamed, its join key and a flag that tells a match from a row of nulls."""
        from ordinate.seq import hidden

        names = {c: f"__{mark}_{c}" for c in seq.columns}
        keys = [(hidden(), d) for _, d in seq.keys]
        df = seq._df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(k).alias(h) for (k, _), (h, _) in zip(seq.keys, keys)], *([] if selector is None else [one(selector, seq.row()).alias(f"__{mark}key")]), F.lit(True).alias(f"__{mark}"))
        return df, Row({c: F.col(f"`{n}`") for c, n in names.items()}), keys

    @staticmethod
    def _or(row: Row, flag: str, default: Any) -> Row:
        """The row with a default in place of an absent one."""
        if default is None:
            return row
        values = default if isinstance(default, dict) else {c: default for c in row._columns}
        return Row({c: F.when(F.col(flag).isNull(), as_column(values.get(c))).otherwise(v) for c, v in row._columns.items()})

    def _join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector, how: str, default_outer: Any = None, default_inner: Any = None):
        left, o, left_keys = self._side(self.seq, outer_key, "l")
        right, i, right_keys = self._side(inner, inner_key, "r")
        joined = left.join(right, F.col("__lkey").eqNullSafe(F.col("__rkey")), how)
        o, i = self._or(o, "__l", default_outer), self._or(i, "__r", default_inner)
        made = many(result, o, i) if result is not None else {**{f"outer_{c}": v for c, v in o._columns.items()}, **{f"inner_{c}": v for c, v in i._columns.items()}}
        keys = [*right_keys, *left_keys] if how == "right" else [*left_keys, *right_keys]
        if how == "full":  # outer rows first, then what only the inner side has
            from ordinate.seq import hidden

            side = hidden()
            joined, keys = joined.withColumn(side, F.col("__l").isNull().cast("int")), [(side, False), *keys]
        return self.seq.with_rows(joined.select(*[c.alias(n) for n, c in made.items()], *[k for k, _ in keys]), list(made), keys, 0)

    def join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector = None):
        """Pairs with equal keys."""
        return self._join(inner, outer_key, inner_key, result, "inner")

    def left_join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector = None, default_inner: Any = None):
        """Pairs, and outer items without a match with a default."""
        return self._join(inner, outer_key, inner_key, result, "left", None, default_inner)

    def right_join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector = None, default_outer: Any = None):
        """Pairs, and inner items without a match with a default, in inner order."""
        return self._join(inner, outer_key, inner_key, result, "right", default_outer)

    def full_outer_join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector = None, default_outer: Any = None, default_inner: Any = None):
        """Pairs and the unmatched items of both sides."""
        return self._join(inner, outer_key, inner_key, result, "full", default_outer, default_inner)

    def group_join(self, inner, outer_key: Selector, inner_key: Selector, result: Selector = None, **aggregates):
        """One item for each outer item, with aggregates of its matches (name -> function from the inner row), or all of them as ``items``.

        The inner side is added up by key before the join.  ``result`` gets the outer row and a row of the aggregates.
        """
        left, o, left_keys = self._side(self.seq, outer_key, "l")
        if aggregates:
            grouped = inner._df.groupBy(one(inner_key, inner.row()).alias("__rkey")).agg(*[f(inner.row()).alias(f"__g_{n}") for n, f in aggregates.items()])
            found = {n: F.col(f"__g_{n}") for n in aggregates}
        else:
            from ordinate.operators.grouping import in_order

            seq, at = inner.positioned("group_join")
            grouped = seq._df.groupBy(one(inner_key, seq.row()).alias("__rkey")).agg(in_order(at, seq.item()).alias("__g_items"))
            found = {"items": F.coalesce("__g_items", F.array().cast(grouped.schema["__g_items"].dataType))}
        joined = left.join(grouped, F.col("__lkey").eqNullSafe(F.col("__rkey")), "left")
        made = many(result, o, Row(found)) if result is not None else {**o._columns, **found}
        return self.seq.with_rows(joined.select(*[c.alias(n) for n, c in made.items()], *[k for k, _ in left_keys]), list(made), left_keys, 0)

    def cross_join(self, inner, result: Selector = None):
        """All pairs; its size is the product, as asked for."""
        left, o, left_keys = self._side(self.seq, None, "l")
        right, i, right_keys = self._side(inner, None, "r")
        made = many(result, o, i) if result is not None else {**{f"outer_{c}": v for c, v in o._columns.items()}, **{f"inner_{c}": v for c, v in i._columns.items()}}
        keys = [*left_keys, *right_keys]
        return self.seq.with_rows(left.crossJoin(right).select(*[c.alias(n) for n, c in made.items()], *[k for k, _ in keys]), list(made), keys, 0)


