"""Filter, projection, slices, sort and search: the methods of a sequence itself."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T
from pyspark.sql import functions as F

from ordinate.functions.selectors import Selector, many, one, truth
from ordinate.plans.position import before, ordering

#: Python types by the Spark types that hold them; a boolean counts as an int too.
STATIC = {
    int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType), float: (T.FloatType, T.DoubleType), bool: (T.BooleanType,),
    str: (T.StringType,), list: (T.ArrayType,), dict: (T.MapType, T.StructType), bytes: (T.BinaryType,),
}
#: More rows than these are skipped by position, not by a top-k.
MOST_BY_BOUND = 100_000
CASTS = {int: "bigint", float: "double", bool: "boolean", str: "string"}


class Core:
    def where(self, predicate: Selector):
        """Items for which the predicate holds; null doesn't."""
        return self.with_rows(self._df.where(truth(predicate, self.row())))

    def select(self, selector: Selector):
        """One item for each item."""
        return self.projected(many(selector, self.row()))

    def select_many(self, selector: Selector):
        """The elements of each item's array, item by item."""
        from ordinate.seq import hidden

        at, key = hidden(), hidden()
        df = self._df.select(F.posexplode(one(selector, self.row())).alias(key, "value"), *[n for n, _ in self.keys])
        if isinstance(df.schema["value"].dataType, T.StructType):
            fields = df.schema["value"].dataType.names
            df = df.select(*[F.col("value")[f].alias(f) for f in fields], F.col(key).alias(at), *[n for n, _ in self.keys])
        else:
            fields, df = ["value"], df.withColumnRenamed(key, at)
        return self.with_rows(df, fields, [*self.keys, (at, False)])

    def select_with_index(self, selector: Selector = None):
        """Projection that also sees the 0-based position."""
        seq, position = self.positioned("select_with_index")
        if selector is None:
            made = {**{c: F.col(f"`{c}`") for c in self.columns}, "index": F.col(position)}
        else:
            made = many(selector(seq.row(), F.col(position)))
        return seq.projected(made)

    def _sorted(self, selector: Selector, down: bool, extend: bool):
        from ordinate.seq import hidden

        name = hidden()
        kept = self.sorted_by if extend else 0
        keys = [*self.keys[:kept], (name, down), *self.keys[kept if extend else self.sorted_by :]]
        return self.with_rows(self._df.withColumn(name, one(selector, self.row())), keys=keys, sorted_by=kept + 1)

    def order_by(self, selector: Selector):
        """Stable ascending sort in place of an earlier one; nulls first."""
        return self._sorted(selector, False, False)

    def order_by_descending(self, selector: Selector):
        return self._sorted(selector, True, False)

    def then_by(self, selector: Selector):
        self._need_sort()
        return self._sorted(selector, False, True)

    def then_by_descending(self, selector: Selector):
        self._need_sort()
        return self._sorted(selector, True, True)

    def as_ordered(self):
        """Take the declared order as a sort, so that then_by sorts within its ties."""
        self.need_order("as_ordered")
        return self.with_rows(self._df, sorted_by=len(self.keys))

    def _need_sort(self) -> None:
        if not self.sorted_by:
            raise TypeError("this needs a sorted sequence: order_by or as_ordered first")

    def take(self, count: int):
        """The first ``count``; a negative count leaves out the last ones."""
        self.need_order("take")
        if count < 0:
            return self.reverse().skip(-count).reverse()
        return self.with_rows(self._df.orderBy(*ordering(self.keys)).limit(count))

    def skip(self, count: int):
        """All but the first ``count``; a negative count keeps the last ones.

        A few are found by a top-k, whose last row bounds the rest; many by position.  Neither brings the rest to one task.
        """
        self.need_order("skip")
        if count < 0:
            return self.reverse().take(-count).reverse()
        if not count:
            return self
        if count > MOST_BY_BOUND:
            seq, at = self.positioned("skip")
            return seq.with_rows(seq._df.where(F.col(at) >= count))
        names = [f"__b{i}" for i in range(len(self.keys))]
        first = self._df.select(*[n for n, _ in self.keys]).orderBy(*ordering(self.keys)).limit(count)
        last = first.orderBy(*ordering([(n, not down) for n, down in self.keys])).limit(1)
        bound = last.select(*[F.col(n).alias(b) for (n, _), b in zip(self.keys, names)])
        joined = self._df.join(F.broadcast(bound), F.lit(True))  # one row
        return self.with_rows(joined.where(~before(self.keys, [F.col(b) for b in names], True)).drop(*names))

    def _split_at_failure(self, predicate: Selector, first: bool):
        self.need_order("take_while")
        bad = self._df.where(~truth(predicate, self.row())).orderBy(*ordering(self.keys)).limit(1)
        names = [f"__b{i}" for i in range(len(self.keys))]
        bound = bad.select(F.lit(1).alias("__any"), *[F.col(n).alias(b) for (n, _), b in zip(self.keys, names)])
        joined = self._df.join(F.broadcast(bound), F.lit(True), "left")  # one row at most
        ahead = F.col("__any").isNull() | before(self.keys, [F.col(b) for b in names])
        return self.with_rows(joined.where(ahead if first else ~ahead).drop("__any", *names))

    def take_while(self, predicate: Selector):
        """The items before the first for which the predicate fails."""
        return self._split_at_failure(predicate, True)

    def skip_while(self, predicate: Selector):
        """That first item and all after it."""
        return self._split_at_failure(predicate, False)

    def reverse(self):
        """The inverse order."""
        self.need_order("reverse")
        return self.with_rows(self._df, keys=[(n, not down) for n, down in self.keys], sorted_by=0)

    def _beside(self, element: dict[str, Any] | Any, last: bool):
        from ordinate.seq import hidden

        self.need_order("append")
        values = element if isinstance(element, dict) else {self.columns[0]: element}
        side, schema = hidden(), self._df.schema
        one_row = self._df.sparkSession.range(1).select(
            *[F.lit(values.get(c)).cast(schema[c].dataType).alias(c) for c in self.columns], *[F.lit(None).cast(schema[n].dataType).alias(n) for n, _ in self.keys], F.lit(1 if last else -1).alias(side)
        )
        return self.with_rows(self._df.withColumn(side, F.lit(0)).unionByName(one_row), keys=[(side, False), *self.keys], sorted_by=0)

    def append(self, element: Any):
        """One more item at the end."""
        return self._beside(element, True)

    def prepend(self, element: Any):
        """One more item at the start."""
        return self._beside(element, False)

    def default_if_empty(self, default: Any):
        """The sequence, or the default alone if it is empty."""
        values = default if isinstance(default, dict) else {self.columns[0]: default}
        schema = self._df.schema
        only = self._df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        return self.with_rows(self._df.unionByName(only.join(self._df.limit(1).select(F.lit(1)), F.lit(True), "left_anti")))

    def of_type(self, kind: type | tuple[type, ...], selector: Selector = None):
        """Items whose value is of the type.  A typed column is all or nothing; text counts where it can be cast."""
        kinds = kind if isinstance(kind, tuple) else (kind,)
        value = one(selector if selector is not None else self.columns[0], self.row())
        static = self._df.select(value.alias("v")).schema["v"].dataType
        if any(isinstance(static, STATIC.get(k, ())) for k in kinds):
            return self.with_rows(self._df.where(value.isNotNull()))
        if isinstance(static, T.StringType):
            good = F.lit(False)
            for k in kinds:
                if k in CASTS:
                    good = good | value.try_cast(CASTS[k]).isNotNull()
            return self.with_rows(self._df.where(good))
        return self.with_rows(self._df.where(F.lit(False)))

    # search in sorted sequences
    def find_by_key(self, *prefix: Any):
        """Items whose leading sort keys equal these."""
        self._need_sort()
        if len(prefix) > self.sorted_by:
            raise ValueError("more keys than the sequence is sorted by")
        match = F.lit(True)
        for (name, _), value in zip(self.keys, prefix):
            match = match & F.col(name).eqNullSafe(F.lit(value))
        return self.with_rows(self._df.where(match))

    def between_keys(self, lower: Any, upper: Any):
        """Items whose leading keys are from ``lower`` to ``upper``, both included, in the direction of the sort."""
        self._need_sort()
        low, high = (x if isinstance(x, tuple) else (x,) for x in (lower, upper))
        if len(low) != len(high):
            raise ValueError("bounds differ in length")
        if len(low) > self.sorted_by:
            raise ValueError("more keys than the sequence is sorted by")
        keys = self.keys[: len(low)]
        return self.with_rows(self._df.where(~before(keys, [F.lit(x) for x in low]) & before(keys, [F.lit(x) for x in high], True)))

    def merge_with(self, other):
        """Both sorted sequences as one; on ties this one's items come first."""
        from ordinate.seq import hidden

        self._need_sort()
        other._need_sort()
        n = self.sorted_by
        if [d for _, d in self.keys[:n]] != [d for _, d in other.keys[: other.sorted_by]]:
            raise ValueError("the sequences are sorted by different keys or directions")
        names, side, pos = [hidden() for _ in range(n)], hidden(), hidden()

        def part(seq, number):
            keyed = seq.with_rows(seq._df.withColumns({x: F.col(k) for x, (k, _) in zip(names, seq.keys)}), [*seq.columns, *names])
            moved, at = keyed.positioned("merge_with")
            return moved._df.select(*[F.col(f"`{c}`") for c in self.columns], *names, F.lit(number).alias(side), F.col(at).alias(pos))

        both = part(self, 0).unionByName(part(other, 1))
        return self.with_rows(both, keys=[*[(x, d) for x, (_, d) in zip(names, self.keys)], (side, False), (pos, False)])

    def lag_in_order(self, periods: int = 1, fill: Any = None, selector: Selector = None):
        self._need_sort()
        return self.stats.lag(periods, fill, selector)

    def lead_in_order(self, periods: int = 1, fill: Any = None, selector: Selector = None):
        self._need_sort()
        return self.stats.lead(periods, fill, selector)
