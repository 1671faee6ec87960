"""What the operators share: scratch tables on shared storage, Arrow helpers, the word pattern."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mergelake.sources.store import remove, scratch_folder

#: A word: everything but the six ASCII white-space characters. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

_scopes: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = scratch_folder(spark, name)
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to shared storage and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[tuple[SparkSession, str]]]:
    """Collects the scratch tables made inside; hand the list to :func:`release` once their readers are done.

    What an inner scope has not released by then, the outer one also has.
    """
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(made)


def release(made: list[tuple[SparkSession, str]]) -> None:
    while made:
        spark, path = made.pop()
        remove(spark, path)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def crc32_remainder(column: Column, divisor: int) -> Column:
    """crc32 of a value's text, modulo ``divisor``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


#: Rows of a batch that a function gets at once: bounds what a worker holds as Python objects.
SLICE = 1024


def applied(batches: Iterator[pa.RecordBatch], function, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """``function`` (from a batch to a mapping of columns, or None) on slices of batches, as batches of ``schema``."""
    wanted = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            if (out := function(whole.slice(a, SLICE))) is not None:
                yield pa.RecordBatch.from_arrays([_cast(out[f.name], f.type) for f in wanted], schema=wanted)
    pa.default_memory_pool().release_unused()  # workers live on: what this task does not need is given back


def map_arrow(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` of a function from a batch to a table or None (nothing)."""
    return df.mapInArrow(lambda batches: applied(batches, function, schema), schema)


def _cast(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not isinstance(values, pa.Array):
        return pa.array(values, type=kind)
    return values if values.type == kind else values.cast(kind)
