"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordinate.plans.checkpoints import checkpoint, shared_folder

#: Texts that are Python objects at a time, in bytes; a batch comes in slices of about so many.
SLICE_BYTES = 4_000_000
#: Tasks over the texts of a bounded sample.
SAMPLE_TASKS = 24
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more rows than that; counting stops beyond."""
    return df.limit(rows + 1).count() <= rows


def hash_sample(df: DataFrame, keys: list[str], rows: int, count: int) -> DataFrame:
    """The rows whose keys hash lowest: about 1.25 times ``rows`` of ``count`` distinct keys and a few more, all if they are few.

    A filter in the scan, so that an exact top-k by hash needs to see no more than these.
    """
    share = 1.0 if rows >= count else min(1.0, (1.25 * rows + 200) / count)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text (null: empty text) is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], position: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of one column, a row at least."""
    for batch in batches:
        step = max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.column(position).nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def bound_batches(df: DataFrame) -> None:
    """Fewer rows in an Arrow batch than by default, for texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def map_column(df: DataFrame, column: str, out: str, make: Callable[[], Callable], binary: bool = False, drop: bool = False) -> DataFrame:
    """Append to ``df`` what a Python function makes of one text column; ``drop``: the text doesn't come back.

    ``make()`` runs once in each task and gives a function from a list of texts
    (``bytes`` if ``binary``; None for null) to a list of Arrow arrays, one for
    each column of the schema ``out``.  Batches pass through otherwise untouched.
    """
    added = StructType.fromDDL(out)
    position = df.columns.index(column)
    kept = [k for k in range(len(df.columns)) if not (drop and k == position)]
    bound_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches, position):
            values = batch.column(position)
            if binary:
                values = values.cast(pa.binary())
            made = function(values.to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *made], names=[*[batch.schema.names[k] for k in kept], *added.names])

    return df.mapInArrow(run, StructType([*[df.schema.fields[k] for k in kept], *added.fields]))


def rewrite_texts(df: DataFrame, make: Callable[[], Callable], text: str = "text", size: str = "n_chars") -> DataFrame:
    """Filter rows and rewrite their texts in one pass that keeps all columns.

    ``make()`` gives a function from a list of texts (None for null) to a list
    of new texts and a list of booleans, the rows to keep.  Where a text
    changed, an integer column ``size`` gets its new length.
    """
    names = df.columns
    position = names.index(text)
    at_size = names.index(size) if size in names and df.schema[size].dataType.typeName() in ("long", "integer") else None

    bound_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches, position):
            old = batch.column(position).to_pylist()
            new, keep = function(old)
            columns = list(batch.columns)
            if any(a is not b for a, b in zip(old, new)):
                columns[position] = pa.array(new, columns[position].type)
                if at_size is not None:
                    sizes = columns[at_size].to_pylist()
                    columns[at_size] = pa.array([s if a is b else len(b) for s, a, b in zip(sizes, old, new)], columns[at_size].type)
            made = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield made if all(keep) else made.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
