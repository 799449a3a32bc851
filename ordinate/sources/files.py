"""Readers and writers of whole sequences."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ordinate.seq import Seq

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, order: tuple[str, ...], kind: str = "parquet", schema: str | None = None, **options: str) -> Seq:
    """Files as a sequence in the order of unique columns; give text formats a schema rather than have it inferred."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.format(kind).options(**options)
    return Seq.of((reader.schema(schema) if schema else reader).load(path), order)


def write(seq: Seq, path: str, kind: str = "parquet", mode: str = "errorifexists", ordered: bool = False, partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Write where the rows are.  ``ordered`` sorts the files among each other; csv gets nested columns as JSON text."""
    df = seq.ordered_df if ordered else seq.df
    if kind == "csv":
        df = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema])
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_jdbc(seq: Seq, url: str, table: str, mode: str = "append", **properties: str) -> None:
    """Write to a database; its driver must be on the class path."""
    seq.df.write.jdbc(url, table, mode, properties)
