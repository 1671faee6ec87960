"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document frequencies.

One pass over the texts cuts them into pre-tokens and writes, for blocks of some megabytes of text, a small
dictionary of the block's distinct pre-tokens and, for each document, its frequencies by dictionary index.
The dictionaries meet sorted by pre-token, where each distinct one is counted once; counts go back to their
blocks by index and are multiplied with the frequencies. Token ids are never made. Pre-tokens that are a
vocabulary entry of their own count one and stay out of the dictionaries, so the most frequent ones never travel.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.bpe import pieces
from mergelake.llm.common import arrow_type, field, materialise

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 32 << 20
#: Counts gathered by a task before they are passed on.
FLUSH = 2_000_000


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens), a row for each row of ``docs``.

    Null and empty texts have no bytes and no tokens. Rows with equal ids are counted each for itself; a null id
    stays null. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark, id_field = docs.sparkSession, field(docs, id_col)
    blocks = materialise(_blocks(docs.select(id_col, text_col), id_field, tokenizer_path, block_bytes), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("at", "word")).repartition("word").sortWithinPartitions("word")
    counted = words.mapInArrow(_counter(tokenizer_path), _COUNTED).groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("counted"))
    out = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    joined = blocks.drop("words").join(counted, "block", "left").drop("block")
    return joined.mapInArrow(_summer(id_field.name, arrow_type(id_field.dataType)), out).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _packed(values: np.ndarray) -> bytes:
    """32-bit integers by differences and byte planes, compressed."""
    steps = np.diff(values.astype("<u4"), prepend=np.uint32(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


_COUNTED = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])


def _blocks(texts: DataFrame, id_field: T.StructField, path: str, block_bytes: int) -> DataFrame:
    kind = arrow_type(id_field.dataType)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("n_bytes", T.ArrayType(T.LongType())),
        T.StructField("known", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()), T.StructField("at", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())),
    ])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number = pieces(path), TaskContext.get().partitionId() << 32
        single = tool.single()
        ids: list = []
        n_bytes, known, sizes, at, times, words, held = [], [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            joined = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in (at, times)]
            packed = [pa.array([_packed(x)], pa.binary()) for x in (np.array(sizes, np.uint32), *joined)]
            lists = [pa.array([x], pa.list_(k)) for x, k in ((n_bytes, pa.int64()), (known, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(kind)), *lists, *packed, pa.array([list(words)], pa.list_(pa.string()))], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segments, n = tool.segments(text or "")
                own: Counter = Counter()
                for segment in segments:
                    own.update(tool.pretokens(segment))
                rare: list[tuple[int, int]] = []
                for word, count in own.items():
                    if word in single:
                        n += count
                    else:
                        rare.append((words.setdefault(word, len(words)), count))
                if rare:
                    pairs = np.array(sorted(rare), np.uint32)
                    at.append(pairs[:, 0])
                    times.append(pairs[:, 1])
                size = len((text or "").encode())
                ids.append(key)
                n_bytes.append(size)
                known.append(n)
                sizes.append(len(rare))
                held += size + 64
                if held >= block_bytes:
                    yield block()
                    number += 1
                    ids, n_bytes, known, sizes, at, times, words, held = [], [], [], [], [], [], {}, 0
        if ids:
            yield block()

    return texts.mapInArrow(run, schema)


def _counter(path: str):
    """Of sorted (block, at, word): a word's pieces are counted at its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last, n, held = pieces(path), None, 0, 0
        found: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

        def out() -> pa.RecordBatch:
            packed = [pa.array([np.asarray(x[i], "<u4").tobytes() for x in found.values()], pa.binary()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *packed], ["block", "at", "n"])

        for batch in batches:
            for block, at, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word != last:
                    last, n = word, tool.count(word)
                to = found[block]
                to[0].append(at)
                to[1].append(n)
            held += batch.num_rows
            if held >= FLUSH:
                yield out()
                found.clear()
                held = 0
        if found:
            yield out()

    return run


def _summer(id_name: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("known", "sizes", "at", "times", "counted")}
                sizes = _unpacked(row["sizes"], len(row["known"]))
                at, times = (_unpacked(row[k], int(sizes.sum())) for k in ("at", "times"))
                n = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
                for part in row["counted"] or []:
                    n[np.frombuffer(part["at"], "<u4")] = np.frombuffer(part["n"], "<u4")
                sums = np.concatenate([[0], np.cumsum(n[at] * times)])
                ends = np.cumsum(sizes)
                tokens = np.asarray(row["known"], np.int64) + sums[ends] - sums[ends - sizes]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.cast(kind), batch.column("n_bytes")[i].values, pa.array(tokens)], [id_name, "n_bytes", "n_tokens"])

    return run
