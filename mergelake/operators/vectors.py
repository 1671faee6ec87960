"""Vector search over tables: property parser, inverted lists with quantised codes for each partition and bucket, sign-bit prefilter, exact rerank."""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.functions import hamming_distance, inner_product, squared_distance
from mergelake.operators import log as L
from mergelake.sources.store import Store

#: Rows of a partition's bucket from which its centroids are trained, on average; twice as many at most.
SAMPLE = 20_000
#: Rows that are scored exactly for each one wanted.
RERANK = 20


def _known(metric: str) -> None:
    if metric not in ("L2", "InnerProduct"):
        raise ValueError(f"unknown metric {metric}")


@dataclass(frozen=True)
class VectorConfig:
    """``column:dim[:nlist[:bits[:metric[:rotator[:seed[:faster]]]]]]``: lists of a bucket, bits of a code's component (1 to
    8), FhtKac (signs and Hadamard transforms) or Matrix rotation; with faster, fewer rows are reranked."""

    column: str
    dim: int
    nlist: int = 256
    bits: int = 7
    metric: str = "L2"
    rotator: str = "FhtKac"
    seed: int = 42
    faster: bool = False

    def __post_init__(self):
        _known(self.metric)
        if not 1 <= self.bits <= 8 or self.dim < 1 or self.nlist < 1:
            raise ValueError("expected 1 to 8 bits, and at least one dimension and list")
        if self.rotator not in ("FhtKac", "Matrix"):
            raise ValueError(f"unknown rotator {self.rotator}")

    @classmethod
    def parse(cls, text: str) -> list[VectorConfig]:
        out = []
        for part in filter(None, (p.strip() for p in text.split(","))):
            parts = part.split(":")
            if len(parts) < 2 or len(parts) > 8:
                raise ValueError(f"expected column:dim[:...], got {part}")
            kinds = (str, int, int, int, str, str, int, lambda v: v.lower() == "true")
            out.append(cls(*[k(v) for k, v in zip(kinds, parts, strict=False)]))
        return out


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def distance(column: Column | str, query: Column, metric: str) -> Column:
    """Smaller is nearer for L2; for the product larger is nearer."""
    _known(metric)
    return squared_distance(column, query) if metric == "L2" else inner_product(column, query)


def exact_top_k(df: DataFrame, column: str, query: list[float], k: int = 10, metric: str = "L2", key: str = "id") -> DataFrame:
    """The ``k`` nearest rows with their ``distance``; ties to the smaller key. One ordered limit, no shuffle of the rows."""
    out = df.where(F.size(column) == len(query)).withColumn("distance", distance(column, _literal(query), metric))
    return out.orderBy(F.col("distance").asc() if metric == "L2" else F.col("distance").desc(), key).limit(k)


def sign_bits(column: Column | str, dim: int) -> Column:
    """One bit for each component's sign, 63 to a long, as an array of longs."""
    c = F.col(column) if isinstance(column, str) else column
    words = []
    for at in range(0, dim, 63):
        bits = F.slice(c, at + 1, min(63, dim - at))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)))
    return F.array(*words)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


class Quantiser:
    """Rotated residuals as unit vectors in a few bits a component.

    A residual is its length times a unit vector u; v is the code's vector. The inner product of u with any y is
    estimated by <v, y> / <v, u>, which is unbiased over rotations.
    """

    def __init__(self, config: VectorConfig):
        rng = np.random.default_rng(config.seed)
        self.bits, self.dim, self.kind = config.bits, config.dim, config.rotator
        self.width = 1 << max(0, config.dim - 1).bit_length() if self.kind == "FhtKac" else config.dim
        self.signs = rng.choice([-1.0, 1.0], (3, self.width))
        self.matrix = np.linalg.qr(rng.normal(size=(config.dim, config.dim)))[0] if self.kind == "Matrix" else None

    def rotate(self, x: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return x @ self.matrix
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for signs in self.signs:
            x = _hadamard(x * signs)
        return x

    def encode(self, residuals: np.ndarray, rotated_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, lengths, 1 / <v, u>, and the estimate of <u, c> for each row's centroid c."""
        length = np.linalg.norm(residuals, axis=1)
        unit = self.rotate(residuals) / np.maximum(length, 1e-300)[:, None]
        levels = (1 << self.bits) - 1
        reach = np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-300)
        codes = np.clip(np.rint((unit / reach + 1) / 2 * levels), 0, levels).astype(np.uint8)
        v = self.vectors(codes)
        inverse = 1 / np.maximum((v * unit).sum(1), 1e-300)
        inverse[length == 0] = 0
        return codes, length, inverse, (v * rotated_centroids).sum(1) * inverse

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.float32) * np.float32(2) - np.float32((1 << self.bits) - 1)

    def pack(self, codes: np.ndarray) -> list[bytes]:
        return [c.tobytes() for c in (np.packbits(codes, axis=1) if self.bits == 1 else codes)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        return np.unpackbits(raw, axis=1)[:, : self.width] if self.bits == 1 else raw


class _Centroids:
    """Centroids of partitions and buckets, a small file each; a task keeps the last few that it met."""

    def __init__(self, folder: str):
        self.system, self.root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.kept: OrderedDict[str, np.ndarray] = OrderedDict()

    def write(self, name: str, values: np.ndarray) -> None:
        self.system.create_dir(self.root, recursive=True)
        held = io.BytesIO()
        np.save(held, values)
        with self.system.open_output_stream(f"{self.root}/{name}.npy") as out:
            out.write(held.getvalue())

    def read(self, name: str) -> np.ndarray:
        if name not in self.kept:
            with self.system.open_input_stream(f"{self.root}/{name}.npy") as f:
                self.kept[name] = np.load(io.BytesIO(f.read()))
            if len(self.kept) > 16:
                self.kept.popitem(last=False)
        return self.kept[name]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


class VectorIndex:
    """Inverted lists of vectors, for each partition and bucket of its own; generations agreed on by create-if-absent.

    ``build`` and ``insert`` take the key and vector columns and, where rows come from a table's partitions and
    buckets, ``part`` and ``bucket``. Codes, factors and vectors lie in Parquet sorted by place and list: a search reads
    the codes of the probed lists, then the vectors of the rows to be reranked alone.
    """

    def __init__(self, spark: SparkSession, path: str, config: VectorConfig, key: str):
        self.spark, self.path, self.config, self.key = spark, path, config, key
        self.store = Store(spark, path)

    def _manifest(self) -> tuple[int, dict]:
        names = self.store.names("manifest")
        return (int(names[-1][:-5]), self.store.read("manifest", names[-1])) if names else (-1, {"centroids": "", "segments": [], "versions": {}})

    def _publish(self, number: int, centroids: str, segments: list[str], versions: dict[str, int]) -> None:
        if not self.store.create({"centroids": centroids, "segments": segments, "versions": versions}, "manifest", f"{number + 1:020d}.json"):
            raise L.CommitConflict("another writer made this generation of the index")

    def _places(self, df: DataFrame) -> DataFrame:
        places = [F.col(c) if c in df.columns else F.lit(d).alias(c) for c, d in (("part", ""), ("bucket", 0))]
        rows = df.select(F.col(self.key).alias("key"), F.col(self.config.column).cast("array<double>").alias("vec"), *places)
        # places are named by a hash in files; rows with nulls or another length have no vector
        return rows.where((F.size("vec") == self.config.dim) & ~F.exists("vec", lambda x: x.isNull())).withColumn("place", F.hex(F.xxhash64("part", "bucket")))

    def build(self, df: DataFrame, versions: dict[str, int] | None = None) -> None:
        """A new generation: each place's centroids from a bounded sample of its rows, every row in its nearest list."""
        number, _ = self._manifest()
        rows, centroids = self._places(df), f"centroids-{L.new_id()}"
        self._train(rows, centroids)
        self._publish(number, centroids, [self._segment(rows, centroids)], versions or {})

    def insert(self, df: DataFrame) -> None:
        """Adds rows as a segment of their own, under the centroids of the latest build; places new to it get some first."""
        number, manifest = self._manifest()
        rows = self._places(df)
        known = self.spark.createDataFrame([(n[:-4],) for n in self.store.names(manifest["centroids"])], "place string")
        new = rows.join(known, "place", "left_anti")
        if not new.isEmpty():
            self._train(new, manifest["centroids"])
        self._publish(number, manifest["centroids"], [*manifest["segments"], self._segment(rows, manifest["centroids"])], manifest["versions"])

    def _train(self, rows: DataFrame, folder: str) -> None:
        counts = rows.groupBy("place").agg(F.count(F.lit(1)).alias("rows"))
        draw = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = rows.join(counts, "place").where(draw < 2.0 * SAMPLE / F.col("rows")).select("place", "key", "vec")
        config, where = self.config, self.store.uri(folder)
        out = T.StructType([T.StructField("place", T.StringType())])

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by("key").slice(0, 2 * SAMPLE)
            x, rng = _rows(table["vec"].combine_chunks(), config.dim), np.random.default_rng(config.seed)
            c = x[rng.choice(len(x), min(config.nlist, len(x)), replace=False)].copy()
            for _ in range(10):
                near = np.argmax(x @ c.T - (c**2).sum(1) / 2, axis=1)
                n = np.bincount(near, minlength=len(c))
                sums = np.zeros_like(c)
                np.add.at(sums, near, x)
                c[n > 0] = sums[n > 0] / n[n > 0, None]
            _Centroids(where).write(table["place"][0].as_py(), c)
            return table.select(["place"]).slice(0, 1)

        drawn.groupBy("place").applyInArrow(train, out).agg(F.count("place")).first()

    def _segment(self, rows: DataFrame, folder: str) -> str:
        name, config, where = f"segment-{L.new_id()}", self.config, self.store.uri(folder)
        longs = [T.StructField("bucket", T.IntegerType()), T.StructField("cell", T.IntegerType())]
        out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("part", T.StringType()), T.StructField("place", T.StringType()), *longs, T.StructField("code", T.BinaryType()), *[T.StructField(n, T.DoubleType()) for n in ("length", "inverse", "offset")]])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, quantiser = _Centroids(where), Quantiser(config)
            for whole in batches:
                for place in whole.column("place").unique().to_pylist():
                    batch = whole.filter(pa.compute.equal(whole.column("place"), place))
                    c, x = centroids.read(place), _rows(batch.column("vec"), config.dim)
                    cell = np.argmax(x @ c.T - (c**2).sum(1) / 2, axis=1)
                    codes, *factors = quantiser.encode(x - c[cell], quantiser.rotate(c)[cell])
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec"), batch.column("part"), batch.column("place"), batch.column("bucket").cast(pa.int32()), pa.array(cell.astype(np.int32)), pa.array(quantiser.pack(codes), pa.binary()), *map(pa.array, factors)], out.names)

        made = rows.select("key", "vec", "part", "place", F.col("bucket").cast("int").alias("bucket")).mapInArrow(encode, out)
        made.sortWithinPartitions("place", "cell").write.parquet(self.store.uri(name))
        return name

    def search(self, query: list[float], k: int = 10, nprobe: int = 64, part: str | None = None, rerank: int | None = None) -> DataFrame:
        """The ``k`` nearest keys, with their exact ``distance``, among the ``nprobe`` nearest lists of every place (of one partition, if ``part``).

        Estimates from the codes choose the rows that are scored exactly, ``rerank`` times ``k`` of them.
        """
        _, manifest = self._manifest()
        config, where, q = self.config, self.store.uri(manifest["centroids"]), np.array(query, float)
        keep = (rerank or (RERANK // 4 if config.faster else RERANK)) * k
        stored = self.spark.read.parquet(*[self.store.uri(s) for s in manifest["segments"]])
        if part is not None:
            stored = stored.where(F.col("part") == part)
        key_type = stored.schema["key"].dataType
        cells = T.StructType([T.StructField("p", T.StringType()), T.StructField("c", T.IntegerType()), T.StructField("dot", T.DoubleType()), T.StructField("square", T.DoubleType())])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = _Centroids(where)
            for batch in batches:
                for place in batch.column(0).to_pylist():
                    c = centroids.read(place)
                    dot, square = c @ q, ((c - q) ** 2).sum(1)
                    near = np.argsort(square if config.metric == "L2" else -dot, kind="stable")[:nprobe]
                    yield pa.RecordBatch.from_arrays([pa.array([place] * len(near)), pa.array(near.astype(np.int32)), pa.array(dot[near]), pa.array(square[near])], cells.names)

        probed = stored.select("place").distinct().mapInArrow(probe, cells)
        lists = stored.select("key", "place", "cell", "code", "length", "inverse", "offset").join(probed, (F.col("place") == F.col("p")) & (F.col("cell") == F.col("c")))
        about = T.StructType([T.StructField("near", key_type), T.StructField("about", T.DoubleType())])

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            quantiser = Quantiser(config)
            turned = quantiser.rotate(q[None, :])[0].astype(np.float32)
            for batch in filter(len, batches):
                dots = quantiser.vectors(quantiser.unpack(batch.column("code").to_pylist())) @ turned
                length, inverse, offset, dot, square = (batch.column(c).to_numpy() for c in ("length", "inverse", "offset", "dot", "square"))
                found = length**2 + square - 2 * length * (inverse * dots - offset) if config.metric == "L2" else -(dot + length * inverse * dots)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], about.names)

        # as many as shall be reranked, a bound that the caller sets, whatever the size of the table
        best = lists.select("key", "code", "length", "inverse", "offset", "dot", "square").mapInArrow(estimate, about).orderBy("about", "near").limit(keep)
        rows = stored.select(F.col("key").alias(self.key), F.col("vec").alias(config.column)).join(F.broadcast(best.select("near").distinct()), F.col(self.key) == F.col("near"), "left_semi")
        return exact_top_k(rows, config.column, query, k, config.metric, self.key).select(self.key, "distance")


def index_table(table, path: str, config: VectorConfig) -> VectorIndex:
    """An index of a table with one key column, with lists of its own for each partition and bucket; built anew if the table changed."""
    info = table.info
    if len(info.keys) != 1:
        raise ValueError("an index needs a table with one key column")
    index = VectorIndex(table.spark, path, config, info.keys[0])
    now = {p: table.log.now(p).number for p in table.log.partitions()}
    if index._manifest()[1]["versions"] == now:
        return index
    part = F.concat_ws(",", *[F.concat(F.lit(f"{r}="), F.coalesce(F.col(r).cast("string"), F.lit(L.NULL))) for r in info.ranges]) if info.ranges else F.lit("")
    rows = table.read().select(info.keys[0], config.column, part.alias("part"), F.pmod(F.hash(info.keys[0]), F.lit(info.buckets)).alias("bucket"))
    index.build(rows, now)
    return index


def hamming_top_k(df: DataFrame, column: str, query: list[float], k: int, candidates: int, key: str = "id", metric: str = "L2") -> DataFrame:
    """Sign-bit prefilter: the ``candidates`` rows with the nearest signs, reranked exactly."""
    dim = len(query)
    near = df.withColumn("_bits", hamming_distance(sign_bits(column, dim), sign_bits(_literal(query), dim))).orderBy("_bits", key).limit(candidates).drop("_bits")
    return exact_top_k(near, column, query, k, metric, key)
