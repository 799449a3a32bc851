"""Structure, sampling, function pipelines, parsing and dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinate.functions.selectors import Selector, one, truth
from ordinate.plans.checkpoints import checkpoint

BASE = 1 << 52
#: Steps of unfold in a round.
UNFOLD = 200


def uniform(seed: int, *values: Column) -> Column:
    """In [0, 1), 52 bits of an MD5 of seed and values: the same however the data are partitioned, and in any SQL."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(BASE)


class UtilOps:
    def __init__(self, seq):
        self.seq = seq

    # structure
    def run_length_encode(self, selector: Selector = None):
        """(value, length) of each run of equal values."""
        df, at = self.seq.group.runs(selector)
        done = df.groupBy("__run").agg(F.min_by(one(selector, self.seq.row()), at).alias("value"), F.count("*").alias("length"))
        return self.seq.group._keyed(done, "__run", ["value", "length"])

    def flatten(self, depth: int = 1, selector: Selector = None):
        """Arrays' elements in their place, ``depth`` levels down; text and structs are atoms."""
        seq = self.seq if selector is None else self.seq.select(selector)
        for _ in range(max(depth, 0)):
            name = seq.columns[0]
            if len(seq.columns) != 1 or not isinstance(seq._df.schema[name].dataType, T.ArrayType):
                break
            seq = seq.select_many(name)
        return seq

    def flatten_deep(self, selector: Selector = None):
        """Arrays in arrays, all the way down."""
        seq = self.seq if selector is None else self.seq.select(selector)
        kind, depth = seq._df.schema[seq.columns[0]].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        return seq.util.flatten(depth)

    def transpose(self, selector: Selector = None):
        """Arrays ``items``, one for each place within the rows' arrays; short rows give nulls.  An array holds a value of every row, so one task makes it."""
        seq, at = self.seq.positioned("transpose")
        cells = seq._df.select(F.col(at).alias("r"), F.posexplode(one(selector, seq.row())).alias("c", "v"))
        rows = seq._df.select(F.col(at).alias("r"))
        columns = cells.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))
        last = rows.agg(F.max("r").alias("last"))
        df = columns.crossJoin(F.broadcast(last)).select(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda r: F.try_element_at("m", r)).alias("items"), F.col("c").alias("__c"))
        return self.seq.group._keyed(df, "__c", ["items"])

    def unzip(self) -> tuple:
        """One sequence for each column, or for each field of a struct column."""
        row, columns = self.seq.row(), {c: F.col(f"`{c}`") for c in self.seq.columns}
        if len(columns) == 1 and isinstance(self.seq._df.schema[self.seq.columns[0]].dataType, T.StructType):
            columns = {f: row.item()[f] for f in self.seq._df.schema[self.seq.columns[0]].dataType.names}
        return tuple(self.seq.projected({"value": c}) for c in columns.values())

    def intersperse(self, separator: Any):
        """The separator between items."""
        from ordinate.seq import hidden

        seq, at = self.seq.positioned("intersperse")
        (column,) = seq.columns
        kind, key = seq._df.schema[column].dataType, hidden()
        sep = F.lit(separator).cast(kind)
        pieces = F.when(F.col(at) == 0, F.array(F.col(column))).otherwise(F.array(sep, F.col(column)))
        df = seq._df.select(F.col(at), F.posexplode(pieces).alias(key, column))
        return seq.with_rows(df, [column], [(at, False), (key, False)])

    # sampling: by hashes of a row's keys, so that a seed means the same rows everywhere
    def _keys(self) -> list[Column]:
        self.seq.need_order("sampling")
        return [F.col(n) for n, _ in self.seq.keys]

    def sample(self, n: int, replace: bool = False, seed: int = 0):
        """n items; without replacement at most all of them."""
        if not replace:
            from ordinate.seq import hidden

            name = hidden()
            return self.seq.with_rows(self.seq._df.withColumn(name, uniform(seed, *self._keys())).orderBy(name, *self._keys()).limit(n), keys=[(name, False), *self.seq.keys], sorted_by=0)
        return self._draws(1, n, seed).select(lambda r: {c: r[c] for c in self.seq.columns})

    def _draws(self, times: int, size: int | None, seed: int):
        from ordinate.seq import hidden

        seq, at = self.seq.positioned("sample")
        count = seq._df.agg(F.count("*").alias("__n"))
        size = size or seq.df.count()
        k, place = hidden(), hidden()
        ids = seq._df.sparkSession.range(times * size).crossJoin(F.broadcast(count)).where("__n > 0")
        drawn = ids.select(F.floor(F.col("id") / max(size, 1)).alias("sample_id"), F.col("id").alias(k), F.floor(uniform(seed, F.col("id")) * F.col("__n")).alias(place))
        df = drawn.join(seq._df, F.col(place) == F.col(at)).drop(place, at)
        return seq.with_rows(df, ["sample_id", *seq.columns], [(k, False)])

    def bootstrap_sample(self, n_samples: int = 1000, sample_size: int | None = None, seed: int = 0):
        """Resamples with replacement, one after the other, each row with its ``sample_id``."""
        return self._draws(n_samples, sample_size, seed)

    def stratified_sample(self, selector: Selector, per_group: int, seed: int = 0):
        """At most so many items of each key; the least by hash, picked before rows move."""
        from pyspark.sql import Window

        order = Window.partitionBy("__key").orderBy(uniform(seed, *self._keys()), *self._keys())
        df = self.seq._df.withColumn("__key", one(selector, self.seq.row())).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_group)
        return self.seq.with_rows(df.drop("__key", "__r"))

    # effects and caching
    def for_each(self, action: Callable[[Any], None]):
        """Run ``action`` on every row on the executors, at least once each; gives the sequence."""
        self.seq.df.foreach(action)
        return self.seq

    def side_effect(self, name: str | Observation, **metrics: Column):
        """Observe metrics as the query runs, without another pass, under a name for listeners or into an Observation.

        A sort above it samples its input first and counts those rows again, so read the rows by ``df`` or observe sums that bear that.
        """
        return self.seq.with_rows(self.seq._df.observe(name, *[m.alias(n) for n, m in metrics.items()]))

    def memoize(self):
        """Keep the rows once they have been made."""
        return self.seq.with_rows(self.seq._df.persist())

    def memoize_advanced(self) -> Memoized:
        """Rows in order that are fetched once, as far as they are asked for."""
        return Memoized(self.seq)

    # functions
    def pipe(self, function: Callable, *args: Any, **kwargs: Any) -> Any:
        return function(self.seq, *args, **kwargs)

    def pipe_through(self, *operations: Callable):
        return reduce(lambda s, f: f(s), operations, self.seq)

    compose = pipe_through

    def apply_if(self, condition: bool, operation: Callable):
        return operation(self.seq) if condition else self.seq

    def apply_when(self, predicate: Callable, operation: Callable):
        """``operation`` if ``predicate`` of the sequence is true; it may run a query."""
        return operation(self.seq) if predicate(self.seq) else self.seq

    def apply_functions(self, functions: list[Selector]):
        """Every function's value of each item, item by item."""
        row = self.seq.row()
        return self.seq.select_many(lambda r: F.array(*[one(f, row) for f in functions]))

    def lazy_where(self, predicate: Callable, **context: Column):
        """Filter by a predicate of the item and of aggregates of the whole sequence."""
        whole = self.seq._df.agg(*[c.alias(f"__c_{n}") for n, c in context.items()])
        from ordinate.functions.selectors import Row

        df = self.seq._df.crossJoin(F.broadcast(whole))  # one row
        kept = df.where(truth(predicate(self.seq.row(), Row({n: F.col(f"__c_{n}") for n in context}))))
        return self.seq.with_rows(kept.drop(*[f"__c_{n}" for n in context]))

    # parsing
    def try_parse(self, parser: Selector):
        """(parsed as ``value``, items that don't parse); a parser gives null for failure."""
        v = one(parser, self.seq.row())
        good = self.seq.with_rows(self.seq._df.where(v.isNotNull())).select(lambda r: v)
        return good, self.seq.with_rows(self.seq._df.where(v.isNull()))

    def parse_or_default(self, parser: Selector, default: Any = None):
        return self.seq.select(lambda r: {"value": F.coalesce(one(parser, r), F.lit(default))})

    def unfold(self, first: Selector, following: Callable[[Column], Column], most: int | None = None):
        """For each item its seed and what follows, until null; more than ``most`` steps are an error, where given.

        Runs UNFOLD steps at a time; only items that aren't at their end go on to the next round, of which each is written.
        """
        from ordinate.seq import hidden

        start = one(first, self.seq.row())
        kind = self.seq._df.select(start.alias("s")).schema["s"].dataType
        keys = [n for n, _ in self.seq.keys]

        def step(a: Column, _: Column) -> Column:
            last = F.element_at(a, -1)
            return F.when(last.isNull(), a).otherwise(F.concat(a, F.array(following(last).cast(kind))))

        left, rounds, done = self.seq._df.select(start.cast(kind).alias("__s"), *keys), 0, None
        number, place = hidden(), hidden()
        while True:
            made = F.aggregate(F.sequence(F.lit(1), F.lit(UNFOLD)), F.array("__s"), step)
            part = checkpoint(left.where("__s is not null").select(made.alias("__a"), *keys))
            more = F.element_at("__a", -1)
            # the last of a full array starts the next round
            values = F.when(more.isNotNull(), F.slice("__a", 1, F.size("__a") - 1)).otherwise(F.filter("__a", lambda x: x.isNotNull()))
            rows = part.select(F.posexplode(values).alias(place, "value"), F.lit(rounds).alias(number), *keys)
            done = rows if done is None else done.unionByName(rows)
            left, rounds = part.where(more.isNotNull()).select(more.alias("__s"), *keys), rounds + 1
            if left.isEmpty():
                return self.seq.with_rows(done, ["value"], [*self.seq.keys, (number, False), (place, False)])
            if most is not None and rounds * UNFOLD > most:
                raise ValueError("unfold doesn't end")

    def topological_sort(self, key: Selector, depends_on: Selector):
        """Items after all they depend on: by level, then order.  Unknown dependencies don't count; a cycle is an error.

        Levels are peeled off by joins; each round's rest is checkpointed.
        """
        from ordinate.seq import hidden

        seq, at = self.seq.positioned("topological_sort")
        row = seq.row()
        nodes = checkpoint(seq._df.withColumn("__key", one(key, row)).withColumn("__needs", one(depends_on, row)))
        edges = nodes.select("__key", F.explode("__needs").alias("__dep")).distinct()
        edges = edges.join(nodes.select(F.col("__key").alias("__dep")).distinct(), "__dep")
        left, done, level, name = nodes.select("__key").distinct(), None, 0, hidden()
        while not left.isEmpty():
            waiting = edges.join(left.withColumnRenamed("__key", "__dep"), "__dep", "left_semi").select("__key").distinct()
            ready = left.join(waiting, "__key", "left_anti").withColumn(name, F.lit(level))
            if ready.isEmpty():
                raise ValueError("the dependencies form a cycle")
            ready = checkpoint(ready)
            done = ready if done is None else done.union(ready)
            left = checkpoint(left.join(ready.select("__key"), "__key", "left_anti"))
            level += 1
        if done is None:
            return seq
        df = nodes.join(done, "__key").drop("__key", "__needs")
        return seq.with_rows(df.withColumn("level", F.col(name)), [*seq.columns, "level"], [(name, False), (at, False)])


class Memoized:
    """Rows that come from the cluster one partition at a time and stay here once seen."""

    def __init__(self, seq):
        self._df = seq.ordered_df
        self._seen: list[Any] = []
        self._rest: Iterator[Any] | None = None

    def _fetch(self, n: int | None) -> None:
        if self._rest is None:
            self._rest = self._df.toLocalIterator(prefetchPartitions=True)
        while n is None or len(self._seen) < n:
            row = next(self._rest, None)
            if row is None:
                return
            self._seen.append(row)

    def __iter__(self):
        k = 0
        while True:
            self._fetch(k + 1)
            if k >= len(self._seen):
                return
            yield self._seen[k]
            k += 1

    def __getitem__(self, at):
        if isinstance(at, slice):
            self._fetch(None if at.stop is None or at.stop < 0 or (at.start or 0) < 0 else at.stop)
        else:
            self._fetch(None if at < 0 else at + 1)
        return self._seen[at]

    def __len__(self) -> int:
        self._fetch(None)
        return len(self._seen)


