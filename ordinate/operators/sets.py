"""Set, bag and similarity operators; items are compared by value and null equals null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinate.functions.selectors import Selector, one


def _same(a: DataFrame, b: DataFrame, columns, suffix: str = "") -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c + suffix]) for c in columns])


class SetOps:
    def __init__(self, seq):
        self.seq = seq

    def _values(self, other=None) -> None:
        for c in self.seq.columns:
            if isinstance(self.seq._df.schema[c].dataType, T.MapType):
                raise TypeError(f"column {c!r} is a map; maps have no equality")
        if other is not None and list(other.columns) != list(self.seq.columns):
            raise ValueError("both sequences need the same columns")

    def _first(self, what: str, source=None) -> tuple[DataFrame, str]:
        """Distinct items with their first position; added up before they move."""
        seq, at = (source or self.seq).positioned(what)
        return seq._df.groupBy(*seq.columns).agg(F.min(at).alias(at)), at

    def distinct(self, selector: Selector = None):
        """The first item of each value, or of each key, in order of appearance."""
        self._values()
        if selector is None:
            df, at = self._first("distinct")
            return self.seq.with_rows(df, keys=[(at, False)], sorted_by=0)
        seq, at = self.seq.positioned("distinct")
        first = seq._df.groupBy(one(selector, seq.row()).alias("__key")).agg(F.min_by(F.struct(*seq.columns), at).alias("__i"), F.min(at).alias(at))
        return seq.with_rows(first.select(*[F.col("__i")[c].alias(c) for c in seq.columns], at))

    def concat(self, other):
        """This sequence's items, then the other's."""
        from ordinate.seq import hidden

        self._values(other)
        (a, x), (b, y) = self.seq.positioned("concat"), other.positioned("concat")
        side, pos = hidden(), hidden()
        part = lambda s, at, k: s._df.select(*[F.col(f"`{c}`") for c in self.seq.columns], F.lit(k).alias(side), F.col(at).alias(pos))
        return self.seq.with_rows(part(a, x, 0).unionByName(part(b, y, 1)), keys=[(side, False), (pos, False)], sorted_by=0)

    def union(self, other):
        """Distinct items of both, in order of appearance."""
        return self.concat(other).set.distinct()

    def intersect(self, other, dedupe: bool = False):
        """Items that the other has too; repeats stay unless ``dedupe``."""
        self._values(other)
        found = other.df.distinct()
        kept = self.seq.with_rows(self.seq._df.join(found, _same(self.seq._df, found, self.seq.columns), "left_semi"))
        return kept.set.distinct() if dedupe else kept

    def except_(self, other):
        """Distinct items that the other doesn't have."""
        self._values(other)
        df, at = self._first("except_")
        right = other.df.distinct()
        return self.seq.with_rows(df.join(right, _same(df, right, self.seq.columns), "left_anti"), keys=[(at, False)], sorted_by=0)

    def symmetric_difference(self, other):
        """Distinct items of exactly one of both, this one's first."""
        return self.except_(other).set.concat(other.set.except_(self.seq))

    def _counted(self, other, count):
        self._values(other)
        seq, at = self.seq.positioned("multiset")
        columns = seq.columns
        a = seq._df.groupBy(*columns).agg(F.min(at).alias(at), F.count("*").alias("__a"))
        b = other.df.groupBy(*columns).agg(F.count("*").alias("__b")).withColumnsRenamed({c: c + "__r" for c in columns})
        joined = a.join(b, _same(a, b, columns, "__r"), "left")
        n = count(F.col("__a"), F.coalesce("__b", F.lit(0)))
        from ordinate.seq import hidden

        again = hidden()
        df = joined.where(n > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*columns, at, again)
        return seq.with_rows(df, keys=[(at, False), (again, False)])

    def multiset_intersect(self, other):
        """Each item as often as the rarer side has it."""
        return self._counted(other, F.least)

    def except_by_count(self, other):
        """Each item as often as this side has it more."""
        return self._counted(other, lambda a, b: a - b)

    # comparisons: one row with one flag, and the flag's value
    def relation(self, other) -> DataFrame:
        """One row: n_both, n_left, n_right, the numbers of distinct items on both sides and on one only."""
        self._values(other)
        sides = self.seq.df.withColumn("__s", F.lit(1)).unionByName(other.df.withColumn("__s", F.lit(2)))
        each = sides.groupBy(*self.seq.columns).agg(F.bit_or("__s").alias("__s"))
        return each.agg(*[F.count_if(F.col("__s") == k).alias(n) for n, k in (("n_both", 3), ("n_left", 1), ("n_right", 2))])

    FLAGS = {
        "is_subset_of": "n_left = 0", "is_superset_of": "n_right = 0", "is_proper_subset_of": "n_left = 0 AND n_right > 0",
        "is_proper_superset_of": "n_right = 0 AND n_left > 0", "is_disjoint_with": "n_both = 0",
        "jaccard_similarity": "CASE WHEN n_both + n_left + n_right = 0 THEN 1.0D ELSE n_both / (n_both + n_left + n_right) END",
    }

    def compare(self, other, *what: str) -> DataFrame:
        """One row with these comparisons as columns."""
        return self.relation(other).select(*[F.expr(self.FLAGS[w]).alias(w) for w in what])

    def _value(self, other, what: str):
        return self.compare(other, what).first()[0]

    def is_subset_of(self, other) -> bool:
        return self._value(other, "is_subset_of")

    def is_superset_of(self, other) -> bool:
        return self._value(other, "is_superset_of")

    def is_proper_subset_of(self, other) -> bool:
        return self._value(other, "is_proper_subset_of")

    def is_proper_superset_of(self, other) -> bool:
        return self._value(other, "is_proper_superset_of")

    def is_disjoint_with(self, other) -> bool:
        return self._value(other, "is_disjoint_with")

    def jaccard_similarity(self, other) -> float:
        return float(self._value(other, "jaccard_similarity"))
