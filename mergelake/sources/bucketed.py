"""Bucketed files without a metastore table: Spark's own layout, so that a scan of any set of them is known to be dealt by key.

Spark gives a scan the partitioning of its files only if its relation has a bucket specification, which Python can
state for catalog tables alone. Here the relation is made of the files of a snapshot and handed to Spark; merges,
aggregates and joins on the keys then need no exchange, and equalities on a single key skip the other buckets' files.
"""

from __future__ import annotations

import contextlib
import math
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Local folders that the driver lists itself.
LISTED_HERE = 2048
#: Bytes of files that one task merges; where a bucket has twice as many, rows are dealt to more tasks than there are buckets.
#: Sorted keys take little room: half a million rows of three columns are 4 MB in files and some 300 MB in a sort.
TASK_BYTES = 4 << 20
#: And rows: keys in a row beside a constant take little more than a byte in files, and some 150 in a sort.
TASK_ROWS = 1 << 20
#: Bytes of a bucket below which its rows are not counted, and the most footers that are read to count them.
DENSE_BYTES, FOOTERS = 1 << 20, 4
#: Shuffled bytes that one task writes; a bucket with more becomes several files. Sorting takes several times as much, of narrow rows most.
PIECE_BYTES = 32 << 20


def _seq(spark: SparkSession, items: Sequence):
    held = spark._jvm.java.util.ArrayList()
    for x in items:
        held.add(x)
    return spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(held).toSeq()


def bucket_id(spark: SparkSession, keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row, as the expression by which Spark's writer wants bucketed rows sorted: it need not sort again."""
    tool = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    columns = _seq(spark, [tool.expression(F.col(f"`{k}`")._jc) for k in keys])
    dealt = spark._jvm.org.apache.spark.sql.catalyst.plans.physical.HashPartitioning(columns, buckets)
    return Column(tool.column(dealt.partitionIdExpression()))


def bucket_of_file(path: str) -> int:
    return int(re.search(r"_(\d+)\.", os.path.basename(path))[1])


def piece_of_file() -> Column:
    """Of the files that one commit has for a bucket, the place of a row's file: Spark numbers them in the order of the input."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")


def tasks_for(files: Sequence[tuple[int, int]], buckets: int, rows_per_byte: float = 0.0) -> int:
    """Tasks to merge files, as (bucket, bytes), in: 0 if each bucket is small enough to be one, else how many rows are to be dealt to."""
    sizes: dict[int, int] = {}
    for bucket, size in files:
        sizes[bucket] = sizes.get(bucket, 0) + size
    most, total = max(sizes.values()), sum(sizes.values())
    if most <= 2 * TASK_BYTES and most * rows_per_byte <= 2 * TASK_ROWS:
        return 0
    return max(buckets, -(-total // TASK_BYTES), math.ceil(total * rows_per_byte / TASK_ROWS))


def _footer(spark: SparkSession, path) -> tuple[int, int, int]:
    """Of a Parquet file: its bytes, its rows, and those of its first row group."""
    parquet = spark._jvm.org.apache.parquet.hadoop
    file = parquet.util.HadoopInputFile.fromPath(path, spark._jsparkSession.sessionState().newHadoopConf())
    reader = parquet.ParquetFileReader.open(file)
    try:
        groups = reader.getRowGroups()
        return file.getLength(), reader.getRecordCount(), groups.get(0).getRowCount() if groups.size() else 0
    finally:
        reader.close()


def rows_per_byte(spark: SparkSession, files: Sequence[tuple[int, int, str]]) -> float:
    """Of files, as (bucket, bytes, path): by the footers of the largest in the largest bucket, whose others are taken to be as dense as
    the densest of these. 0 where the bucket is too small to matter: no footer is read then."""
    sizes: dict[int, int] = {}
    for bucket, size, _ in files:
        sizes[bucket] = sizes.get(bucket, 0) + size
    largest = max(sizes, key=sizes.get)
    if sizes[largest] < DENSE_BYTES:
        return 0.0
    paths = sorted(((size, path) for bucket, size, path in files if bucket == largest), reverse=True)[:FOOTERS]
    seen = [(size, _footer(spark, spark._jvm.org.apache.hadoop.fs.Path(path))[1]) for size, path in paths]
    rest = sizes[largest] - sum(size for size, _ in seen)
    return (sum(n for _, n in seen) + rest * max(n / size for size, n in seen)) / sizes[largest]


def rows_of_a_task(df: DataFrame) -> int:
    """Rows that one task may read of the Parquet files below ``df``, by at most four footers of each relation; 0 if there are
    none, or too few bytes to matter. Dense files hold tens of millions of rows in less than Spark splits."""
    spark, most = df.sparkSession, 0
    leaves, conf = df._jdf.queryExecution().optimizedPlan().collectLeaves(), spark._jsparkSession.sessionState().conf()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            continue
        index, kind = leaf.relation().location(), leaf.relation().fileFormat().getClass().getSimpleName()
        size = index.sizeInBytes()
        if kind != "ParquetFileFormat" or size < DENSE_BYTES:
            continue
        paths = list(index.inputFiles())
        seen = [_footer(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p))) for p in paths[:: -(-len(paths) // FOOTERS)]]
        split = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // spark.sparkContext.defaultParallelism), size)
        most = max(most, math.ceil(split * max(rows / length for length, rows, _ in seen)), *[first for _, _, first in seen])
    return most


def parts_for(df: DataFrame, buckets: int) -> int:
    """Parts, by key, in which a bucket's rows are dealt: Spark cuts between the tasks that rows come from, and not the rows of one."""
    return max(1, math.ceil(rows_of_a_task(df) / (buckets * 2 * TASK_ROWS)))


def dealt_apart(df: DataFrame, on: Sequence[str], buckets: int) -> DataFrame:
    """A table's rows, to be joined to rows that may be far more: Spark deals those to the table's buckets, however few, to spare
    it an exchange. Where shuffles have more partitions than the table has buckets, its rows are dealt to as many too."""
    few = buckets < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*[F.col(f"`{c}`") for c in on]) if few else df


@contextlib.contextmanager
def _pieces(spark: SparkSession) -> Iterator[None]:
    """A bucket is cut only where it is large, however small the session wants its tasks."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(PIECE_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write(df: DataFrame, folder: str, partitions: Sequence[str], keys: Sequence[str], buckets: int) -> None:
    """Parquet files with their buckets in their names. The catalog entry that Spark's writer makes is taken away again."""
    spark, name = df.sparkSession, f"spark_catalog.default.mergelake_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", folder)
    if partitions:
        writer = writer.partitionBy(*partitions)
    try:
        with _pieces(spark):
            writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay


@contextlib.contextmanager
def _listed_here(spark: SparkSession, paths: Sequence[str]) -> Iterator[None]:
    """Local folders are listed by the driver: a job for it, as stores far away deserve, takes longer than the listing."""
    name = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(name)
    if all(urlsplit(p).scheme in ("", "file") for p in paths):
        spark.conf.set(name, str(max(int(before), LISTED_HERE)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read(spark: SparkSession, paths: Sequence[str], base: str, data: T.StructType, partitions: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows of ``paths`` (folders or files below ``base``) with columns ``data`` and, from folder names, ``partitions``."""
    jvm, session = spark._jvm, spark._jsparkSession
    sources, nothing = jvm.org.apache.spark.sql.execution.datasources, jvm.scala.Option.empty()
    struct = lambda s: jvm.org.apache.spark.sql.types.DataType.fromJson(s.json())
    named = jvm.java.util.HashMap()
    named.put("basePath", base)
    options = getattr(jvm.scala.collection.immutable.Map, "from")(jvm.scala.jdk.javaapi.CollectionConverters.asScala(named))
    cache = getattr(getattr(sources, "NoopCache$"), "MODULE$")
    make = jvm.org.apache.hadoop.fs.Path  # a look-up for each part of the name, so once
    roots = _seq(spark, [make(p) for p in paths])
    with _listed_here(spark, paths):
        index = sources.InMemoryFileIndex(session, roots, options, jvm.scala.Option.apply(struct(partitions)), cache, nothing, nothing)
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, _seq(spark, keys), _seq(spark, keys))
    relation = sources.HadoopFsRelation(index, index.partitionSchema(), struct(data), jvm.scala.Option.apply(spec), sources.parquet.ParquetFileFormat(), options, session)
    return DataFrame(session.baseRelationToDataFrame(relation), spark)
