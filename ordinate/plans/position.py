"""Positions, halos and running totals over a whole ordered sequence without a single-task window.

Rows are range-partitioned by all their keys, from bounds that a sample of rows
gives, sorted where they are, numbered and written; partition totals, of which
there are few, carry over.  So positions are made once, however often they are
read, and a lost executor changes none.  Windows over positions run in buckets
of ROWS_PER_BUCKET rows with copies of the rows near their edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ordinate.plans.checkpoints import checkpoint

ROWS_PER_BUCKET = 1_000_000
#: A row's number within its partition has so many bits in monotonically_increasing_id.
LOCAL_BITS = 33

Key = tuple[str, bool]


def ordering(keys: Sequence[Key]) -> list[Column]:
    """Sort columns; nulls come first ascending and last descending."""
    return [F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc() for name, down in keys]


def before(keys: Sequence[Key], bounds: Sequence[Column], or_equal: bool = False) -> Column:
    """Whether a row's keys sort before the bounds, key by key."""
    result = F.lit(or_equal)
    for (name, down), bound in reversed(list(zip(keys, bounds))):
        c = F.col(f"`{name}`")
        less = F.coalesce(c < bound, c.isNull() & bound.isNotNull())
        more = F.coalesce(c > bound, c.isNotNull() & bound.isNull())
        result = (more if down else less) | (c.eqNullSafe(bound) & result)
    return result


def numbered(df: DataFrame, keys: Sequence[Key], name: str) -> DataFrame:
    """Rows in key order over range partitions, with the partition and the place in it as one number; written, so that it stays."""
    ranged = df.repartitionByRange(*ordering(keys)).sortWithinPartitions(*ordering(keys))
    return checkpoint(ranged.withColumn(name, F.monotonically_increasing_id()))


def with_position(df: DataFrame, keys: Sequence[Key], name: str) -> DataFrame:
    """Add a 0-based position in key order; ``keys`` must be unique to be reproducible."""
    kept = numbered(df, keys, name)
    part = F.shiftright(name, LOCAL_BITS).cast("int")
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row for each partition
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset"))
    placed = kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)) + F.col("__offset")).drop("__part", "__offset")


def in_windows(df: DataFrame, position: str, back: int, ahead: int, columns: dict, rows_per_bucket: int | None = None) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows back and ``ahead`` rows ahead.

    ``columns``: name -> callable from an ordered window spec to a Column.  Rows
    near a bucket's edge are copied to its neighbours, so that each bucket is whole.
    """
    size = max(rows_per_bucket or ROWS_PER_BUCKET, back + ahead + 1)
    p = F.col(position)
    first, last = F.floor((p - ahead) / size), F.floor((p + back) / size)
    spread = df.withColumn("__home", F.floor(p / size)).withColumn("__bucket", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    window = Window.partitionBy("__bucket").orderBy(position)
    done = spread.withColumns({name: make(window) for name, make in columns.items()})
    return done.where("__bucket = __home").drop("__bucket", "__home")


def running(df: DataFrame, position: str, columns: dict[str, tuple[str, Column]], rows_per_bucket: int | None = None) -> DataFrame:
    """Add running aggregates from the start: name -> (sum, min, max or product, value)."""
    size = rows_per_bucket or ROWS_PER_BUCKET
    function = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}
    bucketed = df.withColumn("__bucket", F.floor(F.col(position) / size))
    totals = bucketed.groupBy("__bucket").agg(*[function[kind](value).alias(f"__t_{name}") for name, (kind, value) in columns.items()])
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__bucket", *[function[kind](f"__t_{name}").over(earlier).alias(f"__c_{name}") for name, (kind, _) in columns.items()])
    here = Window.partitionBy("__bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = bucketed.withColumns({f"__l_{name}": function[kind](value).over(here) for name, (kind, value) in columns.items()}).join(F.broadcast(carried), "__bucket")
    combine = {"sum": lambda a, b: F.coalesce(a + b, a, b), "product": lambda a, b: F.coalesce(a * b, a, b), "min": F.least, "max": F.greatest}
    made = {name: combine[kind](F.col(f"__c_{name}"), F.col(f"__l_{name}")) for name, (kind, _) in columns.items()}
    return done.withColumns(made).drop("__bucket", *[f"__{x}_{name}" for name in columns for x in "cl"])
