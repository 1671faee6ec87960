"""Streaming: idempotent sinks, a change source by log position, lookup joins, watermarked windows, topic ingestion."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from mergelake.catalog import Catalog
from mergelake.table import Table, TableError


def write_batch(table: Table, df: DataFrame, batch_id: int, query_id: str, mode: str = "append", merge_schema: bool = False) -> bool:
    """Commits one micro-batch; False if this query has committed it before. Modes: append, complete (replaces all rows), update (keys only)."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        raise TableError("a stream cannot write columns without a type")
    if mode == "update" and not table.info.keys:
        raise TableError("update mode needs keys")
    if table.log.last_batch(query_id) >= batch_id:
        return False
    txn = [query_id, batch_id]
    if mode == "complete":
        table.overwrite(df, merge_schema=merge_schema, txn=txn, whole=True)
    elif table.info.keys:
        table.upsert(df, merge_schema=merge_schema, txn=txn)
    else:
        table.append(df, merge_schema=merge_schema, txn=txn)
    return True  # the batch is a part of the table's one commit: all of it is there, or none and it is replayed


def write_stream(df: DataFrame, table: Table, query_id: str, mode: str = "append", merge_schema: bool = False) -> DataStreamWriter:
    """A writer to start: each batch is committed once, also when it is replayed after a failure."""
    return df.writeStream.queryName(query_id).outputMode(mode).foreachBatch(lambda batch, n: write_batch(table, batch, n, query_id, mode, merge_schema) and None)


class ChangeReader:
    """Micro-batches of what was committed to a table, by position in each partition's log.

    ``poll`` gives rows that came since the position it holds, and moves to ``pending``; ``done`` makes that the
    position, so a batch whose target failed is polled again. ``offset`` can be kept and given back after a restart.
    """

    def __init__(self, table: Table, offset: dict[str, int] | None = None, partition: str | None = None):
        self.table, self.offset, self.partition = table, dict(offset or {}), partition
        self.pending = dict(self.offset)

    def poll(self) -> DataFrame | None:
        log, chosen, self.pending = self.table.log, {}, dict(self.offset)
        for p in [self.partition] if self.partition else log.partitions():
            last, seen = log.now(p), self.offset.get(p, -1)
            if last is None or last.number <= seen:
                continue
            if ids := log.between(p, seen, last.number):
                chosen[p] = ids
            self.pending[p] = last.number
        if not chosen:
            self.done()
            return None
        return self.table._load(chosen)

    def done(self) -> None:
        self.offset = dict(self.pending)


def copy_changes(source: Table, target: Table, query_id: str, reader: ChangeReader | None = None) -> int:
    """Moves everything that came since the reader's position to another table; returns the batches committed."""
    reader, n = reader or ChangeReader(source), 0
    while (batch := reader.poll()) is not None:
        n += write_batch(target, batch, max(reader.pending.values()) + sum(reader.pending.values()), query_id)
        reader.done()
    return n


class LookupCache:
    """A dimension kept by Spark between micro-batches, and read again when it is older than ``ttl`` seconds or its table has
    a new version. Blocks that are lost with an executor are read again from the table's files, of the same versions."""

    def __init__(self, table: Table, condition: str | None = None, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.table, self.condition, self.ttl, self.clock = table, condition, ttl, clock
        self.held: DataFrame | None = None
        self.read_at, self.loads, self.versions = 0.0, 0, {}

    def __call__(self) -> DataFrame:
        now = self.clock()
        if self.held is None or now - self.read_at >= self.ttl:
            versions = {p: self.table.log.now(p).number for p in self.table.log.partitions()}
            if self.held is None or versions != self.versions:
                if self.held is not None:
                    self.held.unpersist()
                self.held, self.versions, self.loads = self.table.read(self.condition).persist(), versions, self.loads + 1
            self.read_at = now
        return self.held


def lookup_join(stream: DataFrame, dimension: Callable[[], DataFrame], on: list[str], sink: Callable[[DataFrame, int], None] | Table, how: str = "left", most: int | None = None, query_id: str = "lookup") -> DataStreamWriter:
    """Joins each micro-batch to the dimension as it is then (a :class:`LookupCache`, or any function that reads it).

    A ``Table`` as sink gets each batch once, also when it is replayed. ``most`` distinct keys is an error, not a truncation.
    """

    def each(batch: DataFrame, n: int) -> None:
        rows = dimension()
        if most is not None and rows.select(*on).distinct().limit(most).count() >= most:
            raise TableError(f"the dimension has {most} or more keys")
        joined = batch.join(rows, on, how)
        if isinstance(sink, Table):
            write_batch(sink, joined.select(*sink.schema.fieldNames()), n, query_id)
        else:
            sink(joined, n)

    return stream.writeStream.foreachBatch(each)


def windowed_counts(events: DataFrame, time_col: str, late: str, size: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts by time window, for streams with a watermark and for batches. A stream's watermark needs an instant: times without
    a zone are taken in the session's zone, and windows are given back without one."""
    plain = isinstance(events.schema[time_col].dataType, T.TimestampNTZType)
    marked = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late) if events.isStreaming else events
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    kind = "timestamp_ntz" if plain else "timestamp"
    return marked.groupBy(window.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), *(by or []), "n")


def sessions(events: DataFrame, time_col: str, gap: str, by: list[str]) -> DataFrame:
    """Session windows that close after a gap."""
    window = F.session_window(time_col, gap)
    return events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def ingest_topics(catalog: Catalog, batch: DataFrame, batch_id: int, schemas: dict[str, T.StructType], query_id: str, keys: dict[str, list[str]] | None = None) -> list[str]:
    """One micro-batch of (topic, value): JSON rows go to a table for each topic, made and widened as needed."""
    done = []
    batch = batch.where(F.col("topic").isin(sorted(schemas))).select("topic", "value").persist()  # each topic is a look at the cache, not at the source
    for topic, struct in sorted(schemas.items()):
        rows = batch.where(F.col("topic") == topic).select(F.from_json(F.col("value").cast("string"), struct).alias("r")).select("r.*")
        name = topic.replace(".", "_").replace("-", "_").lower()
        table = catalog.create_table(name, struct, keys=(keys or {}).get(topic, []), if_not_exists=True)
        if write_batch(table, rows, batch_id, f"{query_id}/{topic}", merge_schema=True):
            done.append(name)
    batch.unpersist()
    return done


def kafka_stream(spark: SparkSession, servers: str, pattern: str, **options: str) -> DataFrame:
    """(topic, value) of topics by pattern; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern).options(**options).load().select("topic", "value")


def row_kind(column: Column) -> Column:
    """+I, +U, -U, -D from insert, update, delete: an update reads as its after-image."""
    return F.when(column == "insert", "+I").when(column == "update", "+U").when(column == "delete", "-D")
