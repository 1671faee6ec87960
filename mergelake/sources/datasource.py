"""``format("mergelake")`` for readers that go by path: batch and micro-batch.

    spark.dataSource.register(TableSource)
    spark.read.format("mergelake").load(path)
    spark.readStream.format("mergelake").load(path)

A task reads the files of one bucket of one partition with Arrow and keeps the last value of each column by key, so a
bucket has to fit into a worker's memory; ``Table.read`` has no such bound and knows all merge operators. With the
option ``push_filters`` equalities over range and key columns are applied before the merge. A stream's
offset is the version of every partition; its batches hold what was committed in between, deletes included.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StringType, StructType

from mergelake.operators import log as L


class ReadStore:
    """The reading half of a store, without a Spark session."""

    def __init__(self, root: str):
        self.system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        self.base = base.rstrip("/")

    def exists(self, *parts: str) -> bool:
        return self.system.get_file_info("/".join([self.base, *parts])).type != fs.FileType.NotFound

    def names(self, *parts: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector("/".join([self.base, *parts]), allow_not_found=True))
        return sorted(os.path.basename(f.path) for f in found)

    def read(self, *parts: str) -> object:
        with self.system.open_input_stream("/".join([self.base, *parts])) as f:
            return json.loads(f.read())


@dataclass
class Bucket(InputPartition):
    """Files of one bucket, oldest first, with the columns that each has."""

    files: list[tuple[str, list[str]]]


class _Reading:
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema, self.options = path, schema, options
        self.meta = _meta(path)
        #: Values that range or key columns may have, from filters; other columns are filtered after the merge, by Spark.
        self.wanted: dict[str, set] = {}

    def may_hold(self, parts: dict[str, str | None]) -> bool:
        return all(c not in parts or parts[c] in {str(v) for v in values} for c, values in self.wanted.items())

    def buckets(self, chosen: dict[str, list[str]]) -> list[Bucket]:
        log, out = L.Log(ReadStore(self.path)), {}
        for p, ids in chosen.items():
            if not self.may_hold(L.partition_values(p)):
                continue
            for _, f in log.active(p, ids):
                out.setdefault((p, f.bucket if self.meta["keys"] else f.path), []).append((f.path, f.columns))
        return [Bucket(files) for _, files in sorted(out.items())]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        store, target = ReadStore(self.path), to_arrow_schema(self.schema)
        keys, tables = self.meta["keys"], []
        for path, columns in partition.files:
            parts = {k[2:]: unquote(v) for k, _, v in (x.partition("=") for x in path.split("/")[2:-1])}
            file = pq.ParquetFile(store.system.open_input_file(f"{store.base}/{path}"))
            raw = file.read([n for n in file.schema_arrow.names if n in target.names])
            for key in keys:
                if key in self.wanted:
                    raw = raw.filter(pc.is_in(raw[key], value_set=pa.array(sorted(self.wanted[key]), raw[key].type)))
            arrays = []
            for f in target:
                if f.name in parts:
                    value = {L.NULL: None, L.EMPTY: ""}.get(parts[f.name], parts[f.name])
                    arrays.append(pa.array([value] * len(raw), pa.string()).cast(f.type))
                elif f.name in raw.column_names:
                    arrays.append(raw[f.name].cast(f.type))
                else:
                    arrays.append(pa.nulls(len(raw), f.type))
            tables.append((pa.table(arrays, names=target.names), set(columns)))
        if not tables:
            return
        if not keys:
            for t, _ in tables:
                yield from t.cast(target).to_batches()
            return
        yield from self._last(tables, target, [*self.meta["ranges"], *keys]).to_batches()

    @staticmethod
    def _last(tables: list[tuple[pa.Table, set[str]]], target: pa.Schema, keys: list[str]) -> pa.Table:
        """Of each key and column the last row among files that have the column."""
        begins, at = [], 0
        for t, _ in tables:
            begins.append(at)
            at += len(t)
        whole = pa.concat_tables([t for t, _ in tables]).append_column("_at", pa.array(range(at), pa.int64()))
        newest = whole.select([*keys, "_at"]).group_by(keys).aggregate([("_at", "max")]).sort_by("_at_max")
        out: dict[str, pa.ChunkedArray] = {}
        for columns in {frozenset(i for i, (_, have) in enumerate(tables) if f.name in have) for f in target if f.name not in keys}:
            rows = pa.concat_tables([whole.slice(begins[i], len(tables[i][0])) for i in sorted(columns)]) if columns else whole.slice(0, 0)
            last = rows.select([*keys, "_at"]).group_by(keys).aggregate([("_at", "max")]).rename_columns([*keys, "_own"])
            placed = newest.join(last, keys, join_type="left outer").sort_by("_at_max")
            for f in target:
                if f.name not in keys and frozenset(i for i, (_, have) in enumerate(tables) if f.name in have) == columns:
                    out[f.name] = whole[f.name].take(placed["_own"])
        return pa.table([newest[f.name] if f.name in keys else out[f.name] for f in target], names=target.names).cast(target)


def _meta(path: str) -> dict:
    store = ReadStore(path)
    meta = store.read("_meta", store.names("_meta")[-1])
    if json.loads(meta["properties"].get("merge_operators", "{}")):
        raise NotImplementedError("merge operators need Table.read")
    return meta


class TableReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        log = L.Log(ReadStore(self.path))
        return self.buckets({p: v.snapshot for p in log.partitions() if (v := log.now(p))}) or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        kind = self.meta["properties"].get("cdc_change_column")
        for batch in super().read(partition):
            if kind and self.options.get("keep_deleted", "false").lower() != "true":
                batch = batch.filter(pc.not_equal(batch[kind], "delete"))
            yield batch


class FilteredReader(TableReader):
    """With ``option("push_filters", "true")``; Spark refuses such readers unless ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and IN lists over range and key columns leave out partitions and rows before the merge; Spark applies all again."""
        below = {f.name for f in self.schema.fields if f.name in (*self.meta["ranges"], *self.meta["keys"]) and isinstance(f.dataType, (StringType, IntegralType))}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in below:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if None not in values:
                    self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            yield f


class TableStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        log = L.Log(ReadStore(self.path))
        return {p: v.number for p in log.partitions() if (v := log.now(p))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        log = L.Log(ReadStore(self.path))
        return self.buckets({p: ids for p, n in end.items() if (ids := log.between(p, start.get(p, -1), n))}) or [Bucket([])]

    def commit(self, end: dict) -> None:
        """Nothing to forget: the log keeps its versions."""


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mergelake"

    def schema(self) -> StructType:
        meta = _meta(self.options["path"])
        dropped = set(json.loads(meta["properties"].get("dropped_columns", "[]")))
        return StructType([f for f in StructType.fromJson(json.loads(meta["schema"])).fields if f.name not in dropped])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteredReader if self.options.get("push_filters", "").lower() == "true" else TableReader
        return kind(self.options["path"], schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TableStreamReader(self.options["path"], schema, dict(self.options))
