"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordinate.seq import Seq
from ordinate.sources.factories import from_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as sequences; attributes are their names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Seq:
        return from_table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables that gives a Seq or a DataFrame."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = f(Tables(spark, sf_dir))
            return made.df if isinstance(made, Seq) else made

        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return register
