"""Hierarchies kept as rows of (key, parent key).

A traversal is a table with ``depth``, ``path`` (keys from the root) and the
sort path that makes pre-order a sort.  Levels are joined one after the other
and checkpointed every few levels; a key that meets itself is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions.selectors import Selector, one, truth
from ordinate.plans.checkpoints import checkpoint

LEVELS_PER_CHECKPOINT = 10


class TreeOps:
    def __init__(self, seq):
        self.seq = seq

    def _walk(self, key: Selector, parent: Selector, root: object = None, roots: Selector | None = None) -> DataFrame:
        """Items with __key, __parent, depth, path and __sort.  Roots: parent equals ``root`` (null), or a predicate."""
        seq, at = self.seq.positioned("tree")
        row = seq.row()
        nodes = checkpoint(seq._df.select("*", one(key, row).alias("__key"), one(parent, row).alias("__parent")))
        is_root = F.col("__parent").eqNullSafe(F.lit(root)) if roots is None else truth(roots, row)
        level = nodes.where(is_root).withColumns({"depth": F.lit(0), "path": F.array("__key"), "__sort": F.array(at)})
        done, depth = level, 0
        below = nodes if roots is not None else nodes.where(~is_root)
        while True:
            above = level.select(F.col("__key").alias("__parent"), F.col("path").alias("__path"), F.col("__sort").alias("__above"))
            level = below.join(above, "__parent").select(*[F.col(f"`{c}`") for c in nodes.columns], F.lit(depth + 1).alias("depth"), F.concat("__path", F.array("__key")).alias("path"), F.concat("__above", F.array(at)).alias("__sort"), F.array_contains("__path", F.col("__key")).alias("__again"))
            level = checkpoint(level)
            state = level.agg(F.count("*").alias("n"), F.max("__again").alias("again")).first()
            if state["again"]:
                raise ValueError("the hierarchy has a cycle")
            if not state["n"]:
                return done
            level = level.drop("__again")
            done, depth = done.unionByName(level), depth + 1
            if depth % LEVELS_PER_CHECKPOINT == 0:
                done = checkpoint(done)

    def _seq(self, df: DataFrame, columns: list[str]):
        from ordinate.seq import hidden

        name = hidden()
        return self.seq.with_rows(df.withColumn(name, F.col("__sort")), columns, [(name, False)], 0)

    def traverse_with_path(self, key: Selector, parent: Selector, root: object = None):
        """Pre-order with ``path`` (keys, the item's own last) and ``depth`` (from 0)."""
        return self._seq(self._walk(key, parent, root), [*self.seq.columns, "path", "depth"])

    def recursive_select(self, key: Selector, parent: Selector, include_parents: bool = True, root: object = None):
        """Pre-order; without parents the roots are left out."""
        df = self._walk(key, parent, root)
        return self._seq(df if include_parents else df.where("depth > 0"), list(self.seq.columns))

    def recursive_where(self, key: Selector, parent: Selector, predicate: Selector, root: object = None):
        """Pre-order of the items for which the predicate holds, wherever they are."""
        return self.recursive_select(key, parent, True, root).where(predicate)

    def recursive_select_many(self, key: Selector, parent: Selector, selector: Selector, root: object = None):
        """Pre-order, each item's array taken apart."""
        return self.recursive_select(key, parent, True, root).select_many(selector)

    def select_recursive(self, key: Selector, parent: Selector, leaf: Selector, branch: Callable[[object, Callable], Column], root: object = None):
        """Bottom-up fold as ``value``: ``leaf(item)`` for leaves, ``branch(item, of_children)`` for others.

        ``of_children(aggregate)`` is an aggregate function of the children's values, such as F.sum.
        Each level is one aggregation and one join.
        """
        df = checkpoint(self._walk(key, parent, root))
        row = self.seq.row()
        used: list[tuple[str, Callable]] = []

        def of_children(aggregate: Callable[[str], Column]) -> Column:
            used.append((f"__a{len(used)}", aggregate))
            return F.col(used[-1][0])

        folded, leaf_value = branch(row, of_children), one(leaf, row)
        deepest = df.agg(F.max("depth")).first()[0]
        done = below = None
        for depth in range(deepest if deepest is not None else -1, -1, -1):
            level = df.where(F.col("depth") == depth)
            if below is None:
                made = level.withColumn("value", leaf_value)
            else:
                grouped = below.groupBy(F.element_at("path", -2).alias("__key")).agg(F.lit(True).alias("__has"), *[f("value").alias(n) for n, f in used])
                made = level.join(grouped, "__key", "left").withColumn("value", F.when(F.col("__has"), folded).otherwise(leaf_value))
            below = checkpoint(made.select(*[F.col(f"`{c}`") for c in df.columns], "value"))
            done = below if done is None else done.unionByName(below)
        return self._seq(done if done is not None else df.withColumn("value", leaf_value), [*self.seq.columns, "value"])

    def reduce_tree(self, key: Selector, parent: Selector, aggregate: Callable[[object, Column], Column], root: object = None):
        """An aggregate over all items and their depths, added up in parallel."""
        df = self._walk(key, parent, root)
        return df.agg(aggregate(self.seq.row(), F.col("depth")).alias("v")).first()[0]

    def build_tree(self, key: Selector, parent: Selector, root: object = None):
        """Items that hang on a root, with ``depth``, ``path`` and ``n_children``; orphans are dropped."""
        df = checkpoint(self._walk(key, parent, root))
        children = df.where("depth > 0").groupBy(F.col("__parent").alias("__key")).agg(F.count("*").alias("n_children"))
        joined = df.join(children, "__key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        return self._seq(joined, [*self.seq.columns, "depth", "path", "n_children"])

    def group_by_recursive(self, key: Selector, parent: Selector, group: Selector, root: object = None):
        """(key_path, depth, n, items) of the items whose ancestors' and own group keys are the same, level by level."""
        from ordinate.operators.grouping import in_order

        df = checkpoint(self._walk(key, parent, root).withColumn("__g", one(group, self.seq.row())))
        named = df.select(F.col("__key").alias("__anc"), F.col("__g").alias("__ag"))
        steps = df.select("__key", F.posexplode("path").alias("__i", "__anc")).join(named, "__anc")
        paths = steps.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col("__ag").alias("g")))), lambda x: x["g"]).alias("key_path"))
        found = df.join(paths, "__key").groupBy("key_path").agg(F.count("*").alias("n"), in_order("__sort", self.seq.item()).alias("items"), F.min("__sort").alias("__sort"))
        return self._seq(found.withColumn("depth", F.size("key_path") - 1), ["key_path", "depth", "n", "items"])
