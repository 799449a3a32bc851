"""Permutations, combinations, subsets and products, by position."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


class CombOps:
    def __init__(self, seq):
        self.seq = seq

    def binomial_coefficient(self, r: int) -> int:
        """How many r-subsets there are."""
        n = self.seq.df.count()
        return math.comb(n, r) if 0 <= r <= n else 0

    def _tuples(self, r: int, condition):
        """Arrays ``items`` of r items whose positions meet a condition on each pair (earlier, later)."""
        seq, at = self.seq.positioned("comb")
        base = seq._df.select(seq.item().alias("v"), F.col(at).alias("p"))
        if r == 0:
            one = base.sparkSession.range(1).select(F.array().cast("array<int>").alias("items"), F.array().cast("array<bigint>").alias("__p"))
            return self._keyed(one)
        rows = base.select(F.array("v").alias("items"), F.array("p").alias("__p"))
        for k in range(1, r):
            rows = rows.join(base, condition(F.col("__p"), F.col("p")), "inner").select(F.concat("items", F.array("v")).alias("items"), F.concat("__p", F.array("p")).alias("__p"))
        return self._keyed(rows)

    def _keyed(self, df):
        from ordinate.seq import hidden

        name = hidden()
        return self.seq.with_rows(df.withColumnRenamed("__p", name), ["items"], [(name, False)], 0)

    def _none(self):
        return self._tuples(1, None).take(0)

    def permutations(self, r: int | None = None):
        """Ordered r-tuples of different positions; all items if no r."""
        n = self.seq.df.count() if r is None or r > 0 else 0
        r = n if r is None else r
        if r < 0 or r > n:
            return self._none()
        return self._tuples(r, lambda seen, p: ~F.array_contains(seen, p))

    def combinations(self, r: int):
        """r-subsets in order of position."""
        if r < 0:
            raise ValueError("r must not be negative")
        return self._tuples(r, lambda seen, p: F.element_at(seen, -1) < p)

    def combinations_with_replacement(self, r: int):
        """r-tuples whose positions don't fall."""
        if r < 0:
            raise ValueError("r must not be negative")
        return self._tuples(r, lambda seen, p: F.element_at(seen, -1) <= p)

    def power_set(self, most: int | None = None):
        """All subsets, by size and then position; refuses more than ``most`` items, where given.

        A subset is a number of a range, so the subsets are spread over tasks; from 63 items on there is no such range.
        """
        from ordinate.seq import hidden

        seq, at = self.seq.positioned("power_set")
        n = seq.df.count()
        if n > (62 if most is None else min(most, 62)):
            raise ValueError(f"2^{n} subsets are too many")
        if not n:
            return self._tuples(0, None)
        whole = seq._df.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), seq.item().alias("v")))).alias("all"))  # at most 62 items
        masks = seq._df.sparkSession.range(1 << n).crossJoin(F.broadcast(whole))
        chosen = F.filter("all", lambda x: F.col("id").bitwiseAND(F.pow(F.lit(2), x["p"]).cast("long")) != 0)
        size, place = hidden(), hidden()
        df = masks.withColumn("c", chosen).select(F.transform("c", lambda x: x["v"]).alias("items"), F.size("c").alias(size), F.transform("c", lambda x: x["p"]).alias(place))
        return self.seq.with_rows(df, ["items"], [(size, False), (place, False)], 0)

    def cartesian_product(self, *others):
        """Columns ``item1``, ``item2``, ... of every choice of one item from each sequence."""
        from ordinate.seq import hidden

        df, keys = None, []
        for k, seq in enumerate((self.seq, *others), 1):
            moved, at = seq.positioned("cartesian_product")
            key = hidden()
            part = moved._df.select(moved.item().alias(f"item{k}"), F.col(at).alias(key))
            df, keys = part if df is None else df.crossJoin(part), [*keys, (key, False)]
        return self.seq.with_rows(df, [f"item{k}" for k in range(1, len(others) + 2)], keys, 0)
