"""Approximate nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids, as many as the square root of the rows, cut the vectors into lists. Within a list, residuals are
divided by the list's own scale (so that a tight list of near copies is told apart as finely as a wide one), cut into
sub-vectors and coded by codebooks. A query goes only to the shards that hold one of its probed lists, adds up
asymmetric distance tables over their codes, and scores exactly the rows above its floor: the approximate score that
as many rows of the whole table are expected to reach as shall be reranked, read off a coded sample. How many lists
are probed is found on the sample too, so clustered vectors need few and isotropic ones many. Long lists are cut into
chunks over several shards, and much-asked shards are copied for groups of queries; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import materialise

#: Rows from which centroids and codebooks are fitted: at least and at most (16 a list in between).
SAMPLE, MOST_SAMPLE = 16_384, 262_144
#: Share of a sample's true neighbours that must lie in the lists probed, and the most lists that a query looks at.
RECALL, MOST_PROBES = 0.96, 256
#: Rows of a list's chunk, of a shard, and queries that meet a shard at once: bounds of a task's memory.
CHUNK, SHARD, QUERIES = 4096, 16_384, 4096
#: Rows expected above a query's floor; of a chunk as many are scored exactly at most, in the order of approximate score and id.
RERANK = 256
#: Rows by which the floor is set, and the least rank in them that sets it.
FLOOR_SAMPLE, FLOOR_RANK = 8192, 8
#: Cells of a distance matrix that are made at once.
_CELLS = 1 << 22


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x d
    scales: np.ndarray  # lists
    books: np.ndarray  # parts x codes x d/parts (zero-padded)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = _parts((x - self.centroids[lists]) / self.scales[lists][:, None], self.books.shape[0], self.books.shape[2])
        return np.stack([_nearest(r[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: parts x codes x queries, of inner products with the codebooks."""
        return np.einsum("mcw,qmw->mcq", self.books, _parts(q, self.books.shape[0], self.books.shape[2]), optimize=True).astype(np.float32)

    def about(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sums of the tables over the codes of rows: rows x queries."""
        out = tables[0][codes[:, 0]]
        for m in range(1, len(tables)):
            out += tables[m][codes[:, m]]
        return out


def _parts(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of ``c`` for each row, in blocks of bounded memory."""
    half, step = 0.5 * (c**2).sum(1), max(1, _CELLS // len(c))
    return np.concatenate([np.argmax(x[a : a + step] @ c.T - half, axis=1) for a in range(0, len(x), step)] or [np.empty(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, parts: int = 32, codes: int = 256, seed: int = 42) -> Index:
    """Centroids and codebooks of a sample (rows x dimensions, at least one row)."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, lists, rng)
    near = _nearest(sample, centroids)
    r = sample - centroids[near]
    squares = np.bincount(near, (r**2).sum(1), len(centroids)) / np.maximum(np.bincount(near, minlength=len(centroids)), 1)
    overall = max(1e-12, float(np.sqrt((r**2).sum(1).mean())))
    scales = np.where(squares > (1e-6 * overall) ** 2, np.sqrt(squares), overall)
    parts = min(parts, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    few = rng.choice(len(r), min(len(r), 8192), replace=False)
    cut = _parts(r[few] / scales[near[few]][:, None], parts, width)
    books = [_kmeans(cut[:, m], codes, rng, 5) for m in range(parts)]
    return Index(centroids, scales, np.stack([np.pad(b, ((0, codes - len(b)), (0, 0)), mode="edge") for b in books]))


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float, most: int, queries: int = 256) -> int:
    """The least number of lists that hold ``recall`` of the ``k`` nearest sample rows of some sample rows; at most ``most``."""
    q = sample[: min(queries, len(sample))]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    needed = np.sort(np.take_along_axis(place, index.assign(sample)[near], 1).ravel())
    return int(min(most, len(index.centroids), needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1))


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zeros, and every component a finite number."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


class _Router:
    """Which shards a query goes to: those with a chunk of one of its probed lists. Ships with the tasks."""

    def __init__(self, index: Index, probes: int, sample: np.ndarray, rerank: int, total: int, sizes: dict[int, int]):
        self.index, self.probes, self.total = index, probes, total
        few = sample[:FLOOR_SAMPLE]
        rank = max(FLOOR_RANK, -(-rerank * len(few) // total))
        self.rank = rank if rank < len(few) else 0  # 0: no floor
        self.few_lists = index.assign(few)
        self.few_codes = index.encode(few, self.few_lists)
        lists = len(index.centroids)
        counts = np.array([sizes.get(i, 0) for i in range(lists)], np.int64)
        self.chunks = -(-counts // CHUNK)
        self.first_cell = np.concatenate([[0], np.cumsum(self.chunks)])
        rows = np.repeat(np.where(self.chunks > 0, -(-counts // np.maximum(self.chunks, 1)), 0), self.chunks)
        self.shard_of = (np.cumsum(rows) - rows) // SHARD if len(rows) else np.empty(0, np.int64)  # of cells: a list's chunk each
        self.shards = int(self.shard_of[-1]) + 1 if len(rows) else 1
        self.groups = np.ones(self.shards, np.int64)

    def cells(self, lists: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return self.first_cell[lists] + np.mod(hashes, self.chunks[lists])

    def targets(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, shard) pairs, and each query's least coarse score and floor."""
        index, lists = self.index, len(self.index.centroids)
        coarse = q @ index.centroids.T
        worst = np.partition(coarse, lists - self.probes, axis=1)[:, lists - self.probes]
        floor = np.full(len(q), -np.inf)
        if self.rank:
            about = coarse[:, self.few_lists].T + index.scales[self.few_lists][:, None] * index.about(index.tables(q), self.few_codes)
            floor = np.partition(about, len(about) - self.rank, axis=0)[len(about) - self.rank]
        at, chosen = np.nonzero(coarse >= worst[:, None])
        n = self.chunks[chosen]
        cell = np.repeat(self.first_cell[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        pairs = np.unique(np.repeat(at, n) * self.shards + self.shard_of[cell])
        return pairs // self.shards, pairs % self.shards, worst, floor


def _blocks(batch: pa.RecordBatch, dim: int, wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, _CELLS // max(1, wide))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield part, _matrix(part.column("vec"), dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, most_probes: int = MOST_PROBES, rerank: int = RERANK) -> DataFrame:
    """The ``k`` rows with the largest inner products found for each query: query_id, rank (from 1), id, score (double).

    Queries are the rows of ``vectors`` where ``is_query`` holds; candidates are all rows but those with the query's own
    id. Ties go to the smaller id. Null, zero and non-finite vectors, and null ids, take no part; nor do vectors whose
    length differs from the commonest one. Of rows with equal ids each is a candidate of its own, and a query once, with
    the least of their vectors. An empty table, or one without queries, gives an empty result; very long vectors are
    cut into at most 32 parts like any other. The index is fitted on ``sample`` rows, or 16 a list if that is more, but
    at most 262,144, those with the smallest hashes of their ids, and holds every row. Every query gets ``k`` rows, or
    all there are: those whose lists hold fewer are scored against all shards in a second round. Other columns are ignored.
    """
    spark, id_type, element = vectors.sparkSession, vectors.schema[id_col].dataType, vectors.schema[vector_col].dataType.elementType
    held = T.ArrayType(element if isinstance(element, T.FloatType) else T.DoubleType())
    good = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(held).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = good.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    if lengths is None:
        return _ranked(spark.createDataFrame([], out), k, id_col)
    dim, total = lengths["length"], lengths["count"]
    good = good.where(F.size("vec") == dim)
    lists = max(1, int(np.ceil(np.sqrt(total))))
    wanted = min(max(sample, 16 * lists), MOST_SAMPLE)
    drawn = _matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("vec").toArrow()["vec"], dim)
    index = fit(drawn, lists)
    probes = probes_for(index, drawn[: max(sample, FLOOR_SAMPLE)], k, recall, most_probes)

    coded = T.StructType([T.StructField("vec_id", id_type), T.StructField("vec", held), T.StructField("asks", T.BooleanType()), T.StructField("list", T.IntegerType()), T.StructField("codes", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dim, max(dim, 256)):
                own = index.assign(x)
                codes = index.encode(x, own)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], coded.names)

    stored = materialise(good.mapInArrow(encode, coded), "vectors")
    router = _Router(index, probes, drawn, rerank, total, dict(map(tuple, stored.groupBy("list").count().toLocalIterator())))
    asked = materialise(stored.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    found = materialise(_round(stored, asked, router, dim, k, rerank, out), "found")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, total - 1))
    short = materialise(asked.join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        found = found.join(short, "query_id", "left_anti").select(*out.names).unionAll(_round(stored, short, router, dim, k, 0, out))
    return _ranked(found, k, id_col)


def _round(stored: DataFrame, asked: DataFrame, router: _Router, dim: int, k: int, rerank: int, out: T.StructType) -> DataFrame:
    """The best rows of each shard for the queries that go there; without ``rerank`` every query goes to every shard and all is exact."""
    index, id_type = router.index, out["vec_id"].dataType
    per_shard = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n", T.LongType())])

    def targets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if rerank:
            return router.targets(x)
        nothing = np.full(len(x), -np.inf)
        return np.repeat(np.arange(len(x)), router.shards), np.tile(np.arange(router.shards), len(x)), nothing, nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(router.shards, np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dim, max(FLOOR_SAMPLE, len(index.centroids), router.shards)):
                n += np.bincount(targets(x)[1], minlength=router.shards)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], per_shard.names)

    groups = np.ones(router.shards, np.int64)
    for shard, n in asked.select("vec").mapInArrow(count, per_shard).groupBy("shard").agg(F.sum("n")).toLocalIterator():
        groups[shard] = -(-n // QUERIES)

    row_schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("group", T.LongType()), T.StructField("cell", T.LongType()), *[stored.schema[c] for c in ("vec_id", "vec", "list", "codes")]])
    ask_schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("group", T.LongType()), T.StructField("query_id", id_type), T.StructField("vec", stored.schema["vec"].dataType), T.StructField("worst", T.DoubleType()), T.StructField("floor", T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = router.cells(batch.column("list").to_numpy(), batch.column("hash").to_numpy())
            shard = router.shard_of[cell]
            n = groups[shard]
            at = np.repeat(np.arange(len(n)), n)
            group = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rows = batch.select(["vec_id", "vec", "list", "codes"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(group), pa.array(cell[at]), *rows.columns], row_schema.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dim, max(FLOOR_SAMPLE, len(index.centroids), router.shards)):
                at, shard, worst, floor = targets(x)
                group = np.mod(part.column("hash").to_numpy()[at], groups[shard])
                rows = part.select(["query_id", "vec"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(group), *rows.columns, pa.array(worst[at]), pa.array(floor[at])], ask_schema.names)

    rows = stored.select("vec_id", "vec", "list", "codes", F.xxhash64("vec_id").alias("hash")).mapInArrow(deal, row_schema)
    asking = asked.select("query_id", "vec", F.xxhash64("query_id").alias("hash")).mapInArrow(ask, ask_schema)
    seek = _seeker(index, dim, k, rerank, out)
    return rows.groupBy("shard", "group").cogroup(asking.groupBy("shard", "group")).applyInArrow(seek, out)


def _seeker(index: Index, dim: int, k: int, rerank: int, out: T.StructType):
    def seek(table: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = (queries["query_id"].type, table["vec_id"].type, pa.float64())
        if not len(table) or not len(queries):
            return pa.table([pa.array([], t) for t in kinds], names=out.names)
        table = table.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        x, names, cells, lists = _matrix(table["vec"], dim), table["vec_id"].combine_chunks(), table["cell"].to_numpy(), table["list"].to_numpy()
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(table), -1)
        by_id = np.empty(len(table), np.int64)
        by_id[pc.sort_indices(names).to_numpy()] = np.arange(len(table))
        distinct = pc.unique(names)
        named = pc.index_in(names, value_set=distinct).to_numpy()
        asked = pc.fill_null(pc.index_in(queries["query_id"].combine_chunks(), value_set=distinct), -1).to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        ends = np.append(begins[1:], len(cells))
        q, worst, floor = _matrix(queries["vec"], dim), queries["worst"].to_numpy(), queries["floor"].to_numpy()
        picked: list[list[np.ndarray]] = [[], [], []]
        step = max(1, _CELLS // max(CHUNK, 256 * len(index.books)))
        for a in range(0, len(q), step):
            block = slice(a, a + step)
            coarse, tables = q[block] @ index.centroids[lists[begins]].T, index.tables(q[block]) if rerank else None
            got: list[list[np.ndarray]] = [[], [], []]
            for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                here = np.flatnonzero(coarse[:, i] >= worst[block] - 1e-9 * np.abs(worst[block])) if rerank else np.arange(len(coarse))
                if not len(here):
                    continue
                if rerank:
                    about = index.about(tables[:, :, here], codes[b:e]) * np.float32(index.scales[lists[b]]) + coarse[here, i].astype(np.float32)
                    above = about >= (floor[block][here] - 1e-5).astype(np.float32)
                    for column in np.flatnonzero(above.sum(0) > rerank).tolist():  # in the order of approximate score, then id
                        above[np.argsort(-about[:, column], kind="stable")[rerank:], column] = False
                    row, column = np.nonzero(above)
                    row, who = row + b, here[column] + a
                else:
                    row, who = np.tile(np.arange(b, e), len(here)), np.repeat(here + a, e - b)
                other = named[row] != asked[who]
                row, who = row[other], who[other]
                got[0].append(who)
                got[1].append(row)
                got[2].append(np.concatenate([(x[row[s : s + 65_536]] * q[who[s : s + 65_536]]).sum(1) for s in range(0, len(row), 65_536)] or [np.empty(0)]))
            if got[0]:
                who, row, exact = map(np.concatenate, got)
                order = np.lexsort((by_id[row], -exact, who))
                who, row, exact = who[order], row[order], exact[order]
                starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))[: len(who)]
                rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
                for kept, values in zip(picked, (who, row, exact), strict=True):
                    kept.append(values[rank < k])
        who, row, exact = (np.concatenate(p) if p else np.empty(0, t) for p, t in zip(picked, (np.int64, np.int64, float), strict=True))
        return pa.table([queries["query_id"].take(pa.array(who)), names.take(pa.array(row)), pa.array(exact)], names=out.names)

    return seek


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _matrix(column, dim: int) -> np.ndarray:
    """A double for each component: exactly the stored numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
