"""Rows by their place, file and row index: verdicts on rows are applied where the rows lie, and texts are not shuffled.

A row's place does not depend on how a scan is split, so two scans of the same files agree even when executors came or
went between them. Verdicts, a few bytes a row, are gathered into one small file for each block of a data file, on the
shared folder; a scan's task reads those of the blocks that it meets.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import applied, scratch_path

#: Rows of a data file whose verdicts lie together.
BLOCK = 1 << 20
#: Rows of a batch that are copied at once.
SLICE = 1024


def free_name(docs: DataFrame, base: str) -> str:
    """``base``, or with a number behind it, so that no column of ``docs`` has the name in any case."""
    taken, name, n = {c.lower() for c in docs.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def _file_and_row(docs: DataFrame) -> tuple[Column, Column]:
    meta = docs.metadataColumn("_metadata")  # also where the rows have a column of that name
    return F.lpad(F.hex(F.xxhash64(meta["file_path"])), 16, "0"), meta["row_index"]


def placed(docs: DataFrame, name: str) -> DataFrame:
    """Rows of Parquet files with their place under ``name``: a key of their own, so that repeated or null ids stay apart."""
    file, row = _file_and_row(docs)
    return docs.withColumn(name, F.concat(file, F.lpad(row.cast("string"), 12, "0")))


def taken(docs: DataFrame, verdicts: DataFrame, place: str, times: str | None = None, columns: list[str] | None = None, function=None, schema: T.StructType | None = None) -> DataFrame:
    """The rows of ``docs`` (read from Parquet files) whose place ``verdicts`` names, or each as often as its ``times`` (0 to 255) says.

    Places must not repeat. Columns and their order are those of ``docs``, or ``columns``; rows stay in their
    partitions. With a ``function`` (see :func:`mergelake.llm.common.applied`) its batches of ``schema`` come instead,
    from the same worker.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "verdicts")
    entries = verdicts.select(F.substring(place, 1, 16).alias("file"), F.substring(place, 17, 12).cast("long").alias("at"), (F.col(times) if times else F.lit(1)).cast("int").alias("n")).withColumn("block", F.col("at").bitwiseAND(F.lit(-BLOCK)))
    done = T.StructType([T.StructField("rows", T.LongType())])

    def write(table: pa.Table) -> pa.Table:
        block, at = table["block"][0].as_py(), table["at"].to_numpy()
        held = np.zeros(int(at.max()) - block + 1, np.uint8)
        held[at - block] = table["n"].to_numpy()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        own = f"{root}/{uuid.uuid4().hex}"  # moved to its name whole: another attempt of the task writes the same
        with system.open_output_stream(own, compression=None) as out:
            out.write(zlib.compress(held.tobytes(), 1))
        system.move(own, f"{root}/{table['file'][0].as_py()}-{block}")
        return pa.table({"rows": pa.array([len(at)], pa.int64())})

    entries.groupBy("file", "block").applyInArrow(write, done).agg(F.sum("rows")).first()
    names = [free_name(docs, n) for n in ("place_file", "place_row")]
    file, row = _file_and_row(docs)
    kept = columns or docs.columns
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        now, held = None, np.empty(0, np.uint8)

        def verdict(file: str, at: np.ndarray) -> np.ndarray:
            nonlocal now, held
            out = np.zeros(len(at), np.uint8)
            for block in np.unique(at & -BLOCK).tolist():
                if now != (file, block):
                    now, path = (file, block), f"{root}/{file}-{block}"
                    there = system.get_file_info(path).type != fs.FileType.NotFound
                    held = np.frombuffer(zlib.decompress(system.open_input_stream(path, compression=None).read()), np.uint8) if there else np.empty(0, np.uint8)
                here = np.flatnonzero(((at & -BLOCK) == block) & (at - block < len(held)))
                out[here] = held[at[here] - block]
            return out

        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                files, at = batch.column(width).dictionary_encode(), batch.column(width + 1).to_numpy()
                n = np.zeros(len(at), np.uint8)
                for i, name in enumerate(files.dictionary.to_pylist()):
                    own = np.flatnonzero(files.indices.to_numpy() == i)
                    n[own] = verdict(name, at[own])
                if n.any():
                    rows = batch.select(list(range(width)))
                    yield rows if (n == 1).all() else rows.take(pa.array(np.repeat(np.arange(len(n)), n)))
        pa.default_memory_pool().release_unused()

    rows = docs.withColumns({names[0]: file, names[1]: row}).select(*[F.col(f"`{c}`") for c in kept], *names)
    if function:
        return rows.mapInArrow(lambda batches: applied(run(batches), function, schema), schema)
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in kept]))
