"""Helpers that several operators use."""
from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Words are runs of characters other than space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def lower_ascii(text: str | Column) -> Column:
    """Lower-cases A-Z only; null counts as the empty text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), upper, upper.lower())


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all executors share; see :func:`laborcast.session.shared_folder` where it is unset."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the cluster's checkpoint folder and read again, so that what follows
    neither repeats the work before nor depends on a single executor.

    Nothing needs the shuffle files of the work before any more. Spark removes them once the driver has collected the plans
    they belong to, which it does rarely by itself, so it is asked to: a long job then holds the files of a few steps, not of all.
    """
    checkpoint_folder(df.sparkSession)
    written = df.checkpoint(eager=True)
    del df
    gc.collect()
    written.sparkSession._jvm.System.gc()
    return written


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` followed by ``fields``."""
    return T.StructType([*df.schema.fields, *fields])


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with arrays appended, every string or list in the layout with 32-bit offsets."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches whose texts come to about ``most`` bytes (one text at least), with the texts as Python strings.

    Null texts are empty strings. The parts bound a task's memory; they have no effect on any result.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.nbytes // max(1, len(column))
        start = 0
        while start < len(column):
            rows = max(1, min(len(column) - start, most // max(1, sizes)))
            while rows > 1 and column.slice(start, rows).nbytes > 2 * most:
                rows //= 2
            part = batch.slice(start, rows)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            start += rows
