"""Packing: first-fit decreasing with a tournament tree of bin capacities, independently in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mergelake.llm.bpe import pieces
from mergelake.llm.common import arrow_type, field

#: Documents that a group holds on average: about a megabyte of piece descriptions.
GROUP_DOCS = 2048


class CapacityTree:
    """The first of many bins that still has room, in logarithmic time: a complete tree of largest capacities."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.capacity = capacity
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room; returns the bin and the offset there."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        at = node
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return at - self.leaves, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to ``capacity``); equal sizes in the order given."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    tree = CapacityTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(sizes[i]))
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs every document's ids and ``end_id`` into sequences of at most ``capacity`` ids, a row for each piece:

    id, ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of the little-endian 32-bit ids),
    ``doc_tokens``, ``sequence_id`` and ``offset``. Documents longer than a sequence are cut into full sequences and
    a rest; rests and shorter documents are packed by first-fit decreasing in groups dealt at random.

    Null and empty texts are documents of ``end_id`` alone. Rows with equal ids are packed each for itself (their
    group is drawn anew for each row); null ids stay null. An empty table gives an empty result. Other columns are ignored.
    """
    id_field = field(docs, id_col)
    cut = T.StructType([T.StructField("group_key", T.LongType()), T.StructField("row_key", T.LongType()), id_field, *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    out = T.StructType([*cut.fields[2:], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    groups = max(1, -(-docs.count() // group_docs))
    kind = arrow_type(id_field.dataType)

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = pieces(tokenizer_path), int(end_id).to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        draw, row = np.random.default_rng([7, task]), task << 32
        for batch in filter(len, batches):
            rows: list[tuple] = []
            drawn = draw.integers(0, groups, batch.num_rows).tolist()
            for key, text, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), drawn, strict=True):
                ids = tool.ids(text or "") + end
                n, row = len(ids) // 4, row + 1
                rows += [(group, row, key, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if i == 2 else pa.int64()) for i, c in enumerate(cols)], cut.names)

    def packer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("row_key", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        kept = table.drop_columns(["group_key", "row_key"])
        return kept.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    return docs.select(id_col, text_col).mapInArrow(cutter, cut).groupBy("group_key").applyInArrow(packer, out)
