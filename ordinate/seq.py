"""Seq: a DataFrame with a declared order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions.selectors import Row, Selector
from ordinate.operators.core import Core
from ordinate.plans.position import Key, ordering, with_position

_number = itertools.count()


def hidden() -> str:
    """A new name for a column that isn't part of the item."""
    return f"__k{next(_number)}"


class Seq(Core):
    """An ordered sequence of items.

    ``df`` holds the items' columns and hidden key columns; ``keys`` says how they
    sort.  The first ``sorted_by`` keys come from order_by and then_by, the rest
    break ties, so sorts are stable.  Nothing runs before a terminal, except
    that positions are made, and written, when an operator first needs them.
    ``dense``: the only key is the rows' position, which the next operator reuses.
    """

    def __init__(self, df: DataFrame, keys: Sequence[Key], columns: Sequence[str], sorted_by: int = 0, dense: bool = False):
        self._df, self.keys, self.columns, self.sorted_by, self.dense = df, tuple(keys), tuple(columns), sorted_by, dense

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Column] | str = ()) -> Seq:
        """A sequence of the rows of ``df``, in the order of columns that together are unique."""
        names = [hidden() for _ in ([order] if isinstance(order, str) else order)]
        values = [F.col(f"`{o}`") if isinstance(o, str) else o for o in ([order] if isinstance(order, str) else order)]
        return cls(df.withColumns(dict(zip(names, values))) if names else df, [(n, False) for n in names], df.columns)

    # plumbing
    def row(self) -> Row:
        return Row({c: F.col(f"`{c}`") for c in self.columns})

    def item(self) -> Column:
        return self.row().item()

    def with_rows(self, df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[Key] | None = None, sorted_by: int | None = None, dense: bool = False) -> Seq:
        return Seq(df, self.keys if keys is None else keys, self.columns if columns is None else columns, self.sorted_by if sorted_by is None else sorted_by, dense)

    def projected(self, made: dict[str, Column]) -> Seq:
        return self.with_rows(self._df.select(*[c.alias(n) for n, c in made.items()], *[n for n, _ in self.keys]), list(made), dense=self.dense)

    def need_order(self, what: str) -> None:
        if self._df.isStreaming:
            raise ValueError(f"{what} needs the whole sequence; a stream has no end")
        if not self.keys:
            raise ValueError(f"{what} needs a declared order")

    def positioned(self, what: str) -> tuple[Seq, str]:
        """The same sequence with its position as the only key."""
        self.need_order(what)
        if self.dense:
            return self, self.keys[0][0]
        name = hidden()
        df = with_position(self._df, self.keys, name).select(*[F.col(f"`{c}`") for c in self.columns], name)
        return Seq(df, [(name, False)], self.columns, dense=True), name

    @property
    def df(self) -> DataFrame:
        """The items as a DataFrame, in no particular order."""
        return self._df.select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def ordered_df(self) -> DataFrame:
        """The items as a DataFrame in order."""
        return self._df.orderBy(*ordering(self.keys)).select(*[F.col(f"`{c}`") for c in self.columns]) if self.keys else self.df

    def indexed(self, name: str = "index") -> DataFrame:
        """The items with their 0-based position."""
        seq, position = self.positioned("indexed")
        return seq._df.select(*[F.col(f"`{c}`") for c in self.columns], F.col(position).alias(name))

    def __len__(self) -> int:
        raise TypeError("use to.count(); a length would run the query")

    def __bool__(self) -> bool:
        raise TypeError("use to.any(); a truth value would run the query")

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    # families of operators
    @cached_property
    def set(self):
        from ordinate.operators.sets import SetOps

        return SetOps(self)

    @cached_property
    def group(self):
        from ordinate.operators.grouping import GroupOps

        return GroupOps(self)

    @cached_property
    def join(self):
        from ordinate.operators.joins import JoinOps

        return JoinOps(self)

    @cached_property
    def zip(self):
        from ordinate.operators.zips import ZipOps

        return ZipOps(self)

    @cached_property
    def comb(self):
        from ordinate.operators.combinatorics import CombOps

        return CombOps(self)

    @cached_property
    def stats(self):
        from ordinate.operators.stats import StatsOps

        return StatsOps(self)

    @cached_property
    def util(self):
        from ordinate.operators.utility import UtilOps

        return UtilOps(self)

    @cached_property
    def tree(self):
        from ordinate.operators.tree import TreeOps

        return TreeOps(self)

    @cached_property
    def to(self):
        from ordinate.operators.terminal import Terminals

        return Terminals(self)


__all__ = ["Seq", "Selector", "hidden"]
