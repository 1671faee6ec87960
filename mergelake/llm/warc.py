"""WARC archives with a two-level capture index.

Tasks write gzip members, one for each record, to files on the shared folder and report where each lies; only what
successful attempts report counts, so a lost executor leaves at most an unread file. The index sorts
reversed-host URL keys by range and writes them in compressed blocks with a sparse directory of each shard's first
keys. A lookup binary-searches the shards' first keys, then the shard's directory, reads one block by range, finds
the capture there by binary search, and reads one record by range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import materialise, scratch_path

#: Index lines in a compressed block.
BLOCK_LINES = 2048
#: Bytes after which a task begins a new archive file.
FILE_BYTES = 1 << 30
#: Compressed bytes of records that a reading task gets on average.
READ_BYTES = 64 << 20
#: Decompressed blocks and open files that a reader keeps.
KEEP = 16

_captures = T.StructType([T.StructField("row", T.LongType()), T.StructField("url_key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
_shards = T.StructType([T.StructField(n, k) for n, k in (("first_key", T.StringType()), ("first_row", T.LongType()), ("file", T.StringType()), ("directory_at", T.LongType()), ("directory_length", T.LongType()))])


def url_key(url: str | None) -> str:
    """Reversed host, then path and query, lower-cased: ``com,example,www)/path?q``. Null and hostless URLs keep what they have."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + path).lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the page whose response it repeats.

    ``name`` makes the record's id, which no other record of the archive may have; ids of pages, which may repeat or be
    null, are percent-encoded in fields of their own (WARC lets writers add fields).
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"Page-ID: {quote(page, safe='')}")
    if refers_to is not None:
        lines[5:5] = [f"Refers-To-Page-ID: {quote(refers_to, safe='')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = lambda raw: {k.lower(): v for k, _, v in (x.partition(": ") for x in raw.decode().split("\r\n")[1:])}
    outer = pairs(head)
    block = rest[: int(outer["content-length"])]
    inner, _, payload = block.partition(b"\r\n\r\n")
    return outer, pairs(inner), payload


class _Out:
    """A file of the shared folder, written from front to back."""

    def __init__(self, folder: str, kind: str):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.name = f"{kind}-{uuid.uuid4().hex}"
        self.stream, self.at = system.open_output_stream(f"{root}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)


class _In:
    """Range reads of the shared folder's files; keeps some open."""

    def __init__(self, folder: str):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, at: int, length: int) -> bytes:
        if name not in self.open:
            self.open[name] = self.system.open_input_file(f"{self.root}/{name}")
            if len(self.open) > KEEP:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(name)
        return self.open[name].read_at(length, at)


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes (row, page, url, payload, refers_to) as WARC files under ``folder``; returns the captures: row, url_key, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, task, n = None, TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            made = []
            for page, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "refers_to")), strict=True):
                if out is None or out.at >= FILE_BYTES:
                    if out:
                        out.stream.close()
                    out = _Out(folder, "warc")
                clean = "".join((url or "").split())
                made.append((task + n, url_key(url), out.name, *out.write(gzip.compress(record(f"{folder}/{task + n}", page, clean, payload, base32_sha1(payload), refers_to, date), 6, mtime=0))))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], _captures.names)
        if out:
            out.stream.close()

    return materialise(records.mapInArrow(run, _captures), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Sorts captures by (url_key, row) and writes index shards; returns the shards in key order.

    The list has an entry for each range partition, so it grows with the number of tasks, not with the captures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines = None, [], []

        def block() -> None:
            packed = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            key, row, *_ = json.loads(lines[0])
            directory.append([key, row, *out.write(packed)])
            lines.clear()

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _Out(folder, "index")
                row, key, *where = values
                lines.append(json.dumps([key, row, *where]))
                if len(lines) >= block_lines:
                    block()
        if out:
            if lines:
                block()
            at, length = out.write(gzip.compress(json.dumps(directory).encode(), 6, mtime=0))
            out.stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (directory[0][0], directory[0][1], out.name, at, length)], _shards.names)

    ordered = captures.repartitionByRange("url_key", "row").sortWithinPartitions("url_key", "row")
    rows = materialise(ordered.mapInArrow(run, _shards), "shards").collect()
    return sorted((r["first_key"], r["first_row"], r["file"], r["directory_at"], r["directory_length"]) for r in rows)


class Index:
    """Lookups in a written index."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.files, self.shards = _In(folder), shards
        self.firsts = [tuple(s[:2]) for s in shards]
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    def _json(self, name: str, at: int, length: int, lines: bool) -> list:
        if (name, at) not in self.kept:
            text = gzip.decompress(self.files.read(name, at, length)).decode()
            self.kept[name, at] = [json.loads(x) for x in text.split("\n")] if lines else json.loads(text)
            if len(self.kept) > KEEP:
                self.kept.popitem(last=False)
        self.kept.move_to_end((name, at))
        return self.kept[name, at]

    def find(self, key: str, row: int) -> tuple[str, int, int] | None:
        """File, offset and length of a capture; None if there is none."""
        s = bisect.bisect_right(self.firsts, (key, row)) - 1
        if s < 0:
            return None
        _, _, name, at, length = self.shards[s]
        directory = self._json(name, at, length, False)
        b = bisect.bisect_right(directory, [key, row, float("inf")]) - 1
        if b < 0:
            return None
        block = self._json(name, *directory[b][2:], True)
        i = bisect.bisect_left(block, [key, row])
        return tuple(block[i][2:]) if i < len(block) and block[i][:2] == [key, row] else None

    def read(self, key: str, row: int) -> bytes:
        if (where := self.find(key, row)) is None:
            raise KeyError((key, row))
        return gzip.decompress(self.files.read(*where))


def read_archives(captures: DataFrame, folder: str, shards: list[tuple]) -> DataFrame:
    """Looks every capture up by (url_key, row) and reads its record: page, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response whose payload does not have the digest or length that its headers name fails the job.
    """
    schema = T.StructType([T.StructField("page", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                made = []
                part = batch.slice(start, 256)
                for key, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    outer, inner, payload = parse(index.read(key, row))
                    kind, size, digest = outer["warc-type"], int(inner["content-length"]), outer["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                        raise ValueError(f"damaged record of {outer['warc-record-id']}")
                    named = [None if x is None else unquote(x) for x in (outer.get("page-id"), outer.get("refers-to-page-id"))]
                    made.append((named[0], size, digest, kind, named[1], payload if kind == "response" else None))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], schema.names)

    # keys are small and what they stand for is not: readers are as many as the records' bytes ask for, not the keys'
    readers = max(captures.sparkSession.sparkContext.defaultParallelism, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    return captures.select("url_key", "row").repartitionByRange(readers, "url_key", "row").sortWithinPartitions("url_key", "row").mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages``, indexes the archives and reads every record back through the index.

    Returns id, ``payload_bytes``, ``payload_digest`` (bare base32 SHA-1), ``record_type``, ``refers_to``, ``payload`` (of
    responses, else null). Of records with equal payloads of at least ``least_bytes`` bytes those with the smallest id are
    responses (all, where rows repeat that id), others revisit that id; smaller payloads are all responses. A null payload
    is empty; a null id is larger than any other, and a null URL is an empty one. Very long payloads are one record each,
    held whole by one task. An empty table gives an empty result. Other columns are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    folder = folder or scratch_path(spark, "warc")
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    firsts = rows.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("own"), F.col("size").alias("own_size")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.col("first").cast("string"))
    joined = rows.join(firsts, (F.col("digest") == F.col("own")) & (F.col("size") == F.col("own_size")), "left")
    records = joined.select(F.col("id").cast("string").alias("page"), "url", "payload", refers.alias("refers_to"))
    captures = write_archives(records, folder)
    read = read_archives(captures, folder, write_index(captures, folder))
    return read.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload")


def oracle_sql() -> str:
    """Page facts in DuckDB's SQL; base32 from the 160 bits of the hexadecimal SHA-1."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = " || ".join(f"substr('{alphabet}', 1 + CAST((v{i} // {32 ** (3 - j)}) % 32 AS INTEGER), 1)" for i in range(8) for j in range(4))
    values = ", ".join(f"CAST('0x' || substr(hex, {5 * i + 1}, 5) AS BIGINT) AS v{i}" for i in range(8))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        v AS (SELECT *, {values} FROM p),
        f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
        SELECT v.page_id, CAST(strlen(v.payload) AS BIGINT) AS payload_bytes, {chars} AS payload_digest,
               CASE WHEN v.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN v.page_id <> f.first THEN f.first END AS refers_to
        FROM v JOIN f USING (payload)"""
