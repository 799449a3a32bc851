"""Sequences from tables, values, ranges and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinate.plans.checkpoints import checkpoint
from ordinate.seq import Seq, hidden

#: Unique keys of the standard tables.
TABLE_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"),
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}


def from_table(spark: SparkSession, sf_dir: str, name: str) -> Seq:
    """One of the standard tables, in the order of its key."""
    return Seq.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLE_KEYS[name])


def from_iterable(spark: SparkSession, data: Iterable[Any], schema: T.StructType | str | None = None) -> Seq:
    """Driver values in their order; plain values become the column ``value``.  Types come from ``schema`` or are inferred."""
    rows = list(data)
    plain = not rows or not isinstance(rows[0], (dict, tuple, list)) and not hasattr(rows[0], "__fields__")
    if schema is None and not rows:
        raise ValueError("an empty sequence needs a schema")
    position = hidden()
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema if " " in schema or ":" in schema else f"value {schema}")
    if plain:
        rows = [(x,) for x in rows]
        schema = schema or spark.createDataFrame(rows, ["value"]).schema
    elif schema is None:
        schema = spark.createDataFrame(rows).schema
    names = schema.names
    numbered = [(k, *([r.get(n) for n in names] if isinstance(r, dict) else r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, T.StructType([T.StructField(position, T.LongType()), *schema.fields]))
    return Seq(df, [(position, False)], names)


def from_range(spark: SparkSession, start: int, count: int) -> Seq:
    """``count`` numbers from ``start``; none if the count isn't positive."""
    return Seq.of(spark.range(start, start + max(count, 0)).select(F.col("id").alias("value")), "value")


def repeat(spark: SparkSession, item: Any, count: int) -> Seq:
    """The same item so many times."""
    position = hidden()
    return Seq(spark.range(max(count, 0)).select(F.lit(item).alias("value"), F.col("id").alias(position)), [(position, False)], ["value"])


def empty(spark: SparkSession, schema: str) -> Seq:
    """No items, of this schema."""
    position = hidden()
    shape = T.StructType.fromDDL(schema)
    return Seq(spark.createDataFrame([], T.StructType([*shape.fields, T.StructField(position, T.LongType())])), [(position, False)], shape.names)


def generate(spark: SparkSession, make: Callable[[Column], Column], count: int) -> Seq:
    """``make`` of the position, an expression that runs on the executors (such as a hash or rand(seed)), so many times."""
    position = hidden()
    return Seq(spark.range(max(count, 0)).select(make(F.col("id")).alias("value"), F.col("id").alias(position)), [(position, False)], ["value"])


def create_tree_from_flat(data: Seq, key: Any, parent: Any, root: Any = None) -> Seq:
    """Flat items with parent keys as a hierarchy; see tree.build_tree."""
    return data.tree.build_tree(key, parent, root)


def recursive_generator(spark: SparkSession, seed: Any, children: Callable[[Column], Column], max_depth: int = 100) -> Seq:
    """Breadth-first: the seed, then level by level the arrays of children, with less than ``max_depth`` levels' depth."""
    level: DataFrame = spark.range(1).select(F.lit(seed).alias("value"), F.array(F.lit(0)).alias("path"))
    done, depth = None, 0
    order = [hidden(), hidden()]
    while depth < max_depth:
        level = checkpoint(level) if depth else level
        if level.isEmpty():
            break
        part = level.select("value", F.lit(depth).alias(order[0]), F.col("path").alias(order[1]))
        done = part if done is None else done.union(part)
        kind = level.schema["value"].dataType
        level = level.select("path", F.posexplode(children(F.col("value"))).alias("p", "v")).select(F.col("v").cast(kind).alias("value"), F.concat("path", F.array("p")).alias("path"))
        depth += 1
    if done is None:
        done = level.limit(0).select("value", F.lit(0).alias(order[0]), F.col("path").alias(order[1]))
    return Seq(done, [(order[0], False), (order[1], False)], ["value"])


