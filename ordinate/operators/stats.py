"""Aggregates, rolling and running values, ranks and scaling."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinate.functions.selectors import Selector, one
from ordinate.plans.position import in_windows, running, with_position


class StatsOps:
    def __init__(self, seq):
        self.seq = seq

    def _value(self, selector: Selector, numeric: bool = True) -> Column:
        value = one(selector if selector is not None else (self.seq.columns[0] if len(self.seq.columns) == 1 else None), self.seq.row())
        if numeric:
            kind = self.seq._df.select(value.alias("v")).schema["v"].dataType
            if not isinstance(kind, (T.NumericType, T.BooleanType)):
                raise TypeError(f"non-numeric values of type {kind.simpleString()}; give a selector")
            value = value.cast("long") if isinstance(kind, T.BooleanType) else value
        return value

    def aggregate(self, **columns: Column) -> DataFrame:
        """One row of these aggregates, added up before they move."""
        return self.seq._df.agg(*[c.alias(n) for n, c in columns.items()])

    def _scalar(self, value: Column) -> Any:
        found = self.aggregate(n=F.count("*"), v=value).first()
        if not found["n"]:
            raise ValueError("empty sequence")
        return found["v"]

    # aggregates as values
    def sum(self, selector: Selector = None):
        """0 if empty; an overflow is an error."""
        return self.aggregate(v=F.sum(self._value(selector))).first()[0] or 0

    def average(self, selector: Selector = None) -> float:
        return float(self._scalar(F.avg(self._value(selector))))

    def std_dev(self, selector: Selector = None) -> float:
        """Of the population."""
        return float(self._scalar(F.stddev_pop(self._value(selector))))

    def _extreme(self, selector: Selector, least: bool):
        if selector is None:
            return self._scalar((F.min if least else F.max)(self._value(None, False)))
        found = self.extreme_item(selector, least).first()
        if found is None:
            raise ValueError("empty sequence")
        return found

    def extreme_item(self, selector: Selector, least: bool = True) -> DataFrame:
        """The first item with the least or greatest key: a top-1 by key, then order."""
        key = one(selector, self.seq.row())
        from ordinate.plans.position import ordering

        self.seq.need_order("min and max of items")
        best = self.seq._df.where(key.isNotNull()).orderBy(key.asc() if least else key.desc(), *ordering(self.seq.keys)).limit(1)
        return best.select(*[F.col(f"`{c}`") for c in self.seq.columns])

    def min(self, selector: Selector = None):
        return self._extreme(selector, True)

    def max(self, selector: Selector = None):
        return self._extreme(selector, False)

    def quantiles(self, qs: list[float], selector: Selector = None) -> DataFrame:
        """One row with ``n`` and ``q``, the exact quantiles (0 to 1) by linear interpolation.

        From the distinct values with their counts, so that no frequent value is hot.
        """
        value = self._value(selector).cast("double")
        distinct = self.seq._df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
        placed = running(with_position(distinct, [("v", False)], "p"), "p", {"upto": ("sum", F.col("c"))})
        total = placed.agg(F.sum("c").alias("n"))
        joined = placed.crossJoin(F.broadcast(total))  # one row
        here = lambda p: (p >= F.col("upto") - F.col("c")) & (p < F.col("upto"))
        parts = []
        for k, q in enumerate(qs):
            at = (F.col("n") - 1) * F.lit(float(q))
            parts += [F.max(F.when(here(F.floor(at)), F.col("v"))).alias(f"l{k}"), F.max(F.when(here(F.ceil(at)), F.col("v"))).alias(f"h{k}"), F.max(at - F.floor(at)).alias(f"f{k}")]
        found = joined.agg(F.max("n").alias("n"), *parts)
        return found.select(F.coalesce("n", F.lit(0)).alias("n"), F.array(*[F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * F.col(f"f{k}") for k in range(len(qs))]).alias("q"))

    def percentile(self, q: float, selector: Selector = None) -> float:
        found = self.quantiles([min(max(q, 0), 100) / 100], selector).first()
        if not found["n"]:
            raise ValueError("empty sequence")
        if not 0 <= q <= 100:
            raise ValueError("percentile must be between 0 and 100")
        return found["q"][0]

    def median(self, selector: Selector = None) -> float:
        return self.percentile(50, selector)

    def modes(self, selector: Selector = None) -> DataFrame:
        """One row (value, n): the most frequent value, the least of several."""
        return self.seq._df.groupBy(self._value(selector, False).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)

    def mode(self, selector: Selector = None):
        found = self.modes(selector).first()
        if found is None:
            raise ValueError("empty sequence")
        return found["value"]

    # sequences of values; all keep the items' columns and add one
    def _windowed(self, name: str, back: int, ahead: int, make: Callable, skip: int = 0, what: str = "window"):
        seq, at = self.seq.positioned(what)
        df = in_windows(seq._df, at, back, ahead, {name: make})
        if skip:
            df = df.where(F.col(at) >= skip)
        return seq.with_rows(df, [*[c for c in seq.columns if c != name], name], dense=not skip)

    def rolling_window(self, size: int, aggregate: Callable[[Column], Column], selector: Selector = None, name: str = "value"):
        """An aggregate (of a column, under a window) over each ``size`` items, at the last of them."""
        if size <= 0:
            raise ValueError("window size must be positive")
        value = self._value(selector, False)
        return self._windowed(name, size - 1, 0, lambda w: aggregate(value).over(w.rowsBetween(-(size - 1), 0)), size - 1, "rolling_window")

    def rolling_sum(self, size: int, selector: Selector = None, name: str = "rolling_sum"):
        self._value(selector)
        return self.rolling_window(size, F.sum, selector, name)

    def rolling_average(self, size: int, selector: Selector = None, name: str = "rolling_average"):
        self._value(selector)
        return self.rolling_window(size, F.avg, selector, name)

    def lag(self, periods: int = 1, fill: Any = None, selector: Selector = None, name: str = "lag"):
        """The value so many items before, or ``fill``; as many items as before, however large ``periods``."""
        value = self._value(selector, False)
        if periods <= 0:
            return self._windowed(name, 0, 0, lambda w: value, 0, "lag")
        return self._windowed(name, periods, 0, lambda w: F.lag(value, periods, fill).over(w), 0, "lag")

    def lead(self, periods: int = 1, fill: Any = None, selector: Selector = None, name: str = "lead"):
        value = self._value(selector, False)
        if periods <= 0:
            return self._windowed(name, 0, 0, lambda w: value, 0, "lead")
        return self._windowed(name, 0, periods, lambda w: F.lead(value, periods, fill).over(w), 0, "lead")

    def diff(self, periods: int = 1, selector: Selector = None, name: str = "diff"):
        """The value less the one so many items before; the first items go."""
        value = self._value(selector)
        return self._windowed(name, periods, 0, lambda w: value - F.lag(value, periods).over(w), periods, "diff")

    def lag_in_order(self, periods: int = 1, fill: Any = None, selector: Selector = None):
        return self.seq.lag_in_order(periods, fill, selector)

    def _running(self, kind: str, selector: Selector, name: str, numeric: bool = True):
        value = self._value(selector, numeric)
        seq, at = self.seq.positioned(f"cumulative_{kind}")
        return seq.with_rows(running(seq._df, at, {name: (kind, value)}), [*[c for c in seq.columns if c != name], name], dense=True)

    def cumulative_sum(self, selector: Selector = None, name: str = "cumulative_sum"):
        return self._running("sum", selector, name)

    def cumulative_product(self, selector: Selector = None, name: str = "cumulative_product"):
        return self._running("product", selector, name)

    def cumulative_max(self, selector: Selector = None, name: str = "cumulative_max"):
        return self._running("max", selector, name, False)

    def cumulative_min(self, selector: Selector = None, name: str = "cumulative_min"):
        return self._running("min", selector, name, False)

    def scan(self, accumulator: str | Callable[[Column, Column], Column], seed: Any, selector: Selector = None):
        """The seed and every prefix's fold, as ``value``.  ``sum``, ``min``, ``max`` and ``product`` stay distributed.

        Any other fold is sequential by nature: it runs in one task, over one array of all values.
        """
        from ordinate.seq import hidden

        value = self._value(selector, False)
        seq, at = self.seq.positioned("scan")
        if isinstance(accumulator, str):
            done = running(seq._df, at, {"__v": (accumulator, value)})
            with_seed = {"sum": lambda c: c + seed, "product": lambda c: c * seed, "min": lambda c: F.least(c, F.lit(seed)), "max": lambda c: F.greatest(c, F.lit(seed))}[accumulator]
            rows = done.select(with_seed(F.col("__v")).alias("value"), (F.col(at) + 1).alias("__p"))
            df = rows.union(rows.sparkSession.range(1).select(F.lit(seed).cast(rows.schema["value"].dataType), F.lit(0).cast("long")))
        else:
            ordered = seq._df.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), value.alias("v")))).alias("a"))
            start = F.array(F.lit(seed))
            folded = F.aggregate("a", start, lambda s, x: F.concat(s, F.array(accumulator(F.element_at(s, -1), x["v"]).cast(ordered.select(F.lit(seed).alias("s")).schema["s"].dataType))))
            df = ordered.select(F.posexplode(folded).alias("__p", "value")).select("value", F.col("__p").cast("long").alias("__p"))
        key = hidden()
        return self.seq.with_rows(df.withColumnRenamed("__p", key), ["value"], [(key, False)], 0)

    def _ranked(self, selector: Selector, ascending: bool, name: str, dense: bool):
        """Ranks from the distinct keys, of which each has a count; no window sees all rows."""
        value = self._value(selector, False)
        seq = self.seq
        keyed = seq._df.withColumn("__key", value)
        distinct = keyed.groupBy("__key").agg(F.count("*").alias("__n"))
        placed = with_position(distinct, [("__key", not ascending)], "__p")
        ranked = placed.withColumn(name, F.col("__p") + 1) if dense else running(placed, "__p", {"__c": ("sum", F.col("__n"))}).withColumn(name, F.col("__c") - F.col("__n") + 1)
        df = keyed.join(ranked.select(F.col("__key").alias("__k"), name), F.col("__key").eqNullSafe(F.col("__k"))).drop("__key", "__k")
        return seq.with_rows(df, [*[c for c in seq.columns if c != name], name])

    def rank(self, selector: Selector = None, ascending: bool = True, name: str = "rank"):
        """Competition rank from 1, at the item's own place."""
        return self._ranked(selector, ascending, name, False)

    def dense_rank(self, selector: Selector = None, ascending: bool = True, name: str = "dense_rank"):
        """Rank without gaps."""
        return self._ranked(selector, ascending, name, True)

    def _with_row(self, one_row: DataFrame, name: str, value: Column, drop: list[str]):
        df = self.seq._df.crossJoin(F.broadcast(one_row)).withColumn(name, value).drop(*drop)
        return self.seq.with_rows(df, [*[c for c in self.seq.columns if c != name], name])

    def quantile_cut(self, q: int, selector: Selector = None, name: str = "bin"):
        """The number of the q - 1 inner quantiles that aren't above the value."""
        if q <= 0:
            raise ValueError("q must be positive")
        value = self._value(selector)
        cuts = self.quantiles([k / q for k in range(1, q)], selector).select(F.col("q").alias("__q")) if q > 1 else self.seq._df.sparkSession.range(1).select(F.array().cast("array<double>").alias("__q"))
        return self._with_row(cuts, name, F.size(F.filter("__q", lambda c: c <= value)), ["__q"])

    def normalize(self, selector: Selector = None, name: str = "normalized"):
        """From 0 (least) to 1 (greatest); 0 if all are equal."""
        value = self._value(selector)
        ends = self.aggregate(__lo=F.min(value), __hi=F.max(value))
        return self._with_row(ends, name, F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((value - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))), ["__lo", "__hi"])

    def standardize(self, selector: Selector = None, name: str = "standardized"):
        """Deviations from the mean in standard deviations of the population; 0 if all are equal."""
        value = self._value(selector)
        moments = self.aggregate(__m=F.avg(value), __s=F.stddev_pop(value))
        return self._with_row(moments, name, F.when(F.col("__s") == 0, 0.0).otherwise((value - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))), ["__m", "__s"])

    def outliers_iqr(self, selector: Selector = None, factor: float = 1.5):
        """Items outside the quartiles by more than ``factor`` interquartile ranges."""
        value = self._value(selector)
        q = self.quantiles([0.25, 0.75], selector).select(F.col("q")[0].alias("__a"), F.col("q")[1].alias("__b"))
        reach = F.lit(factor) * (F.col("__b") - F.col("__a"))
        df = self.seq._df.crossJoin(F.broadcast(q)).where((value < F.col("__a") - reach) | (value > F.col("__b") + reach)).drop("__a", "__b")
        return self.seq.with_rows(df)
