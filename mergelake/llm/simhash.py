"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected components.

Documents with equal fingerprints are one node. Fingerprints are cut into ``budget + 1`` ring segments. By the
strong pigeonring principle, two fingerprints within the budget have a segment from which every chain of l
consecutive segments differs in at most l * budget / segments bits. The first two links of that chain make the
join key: the first segment is equal, the second differs in at most one bit, which is enumerated on one side
(only zero bits are set). The third and fourth links prune before the full Hamming check. Each key's links leave
the task as a spanning forest, so a dense group yields as many edges as it has members, not all its pairs.

Documents whose shingle sets have a Jaccard similarity of 0.8 differ in some 10 of 64 bits, and in up to 24. No chain of
segments is a key at that budget: the second link alone would need thousands of keys a document. There,
:func:`similar_documents` takes as candidates those that share a band of least shingle hashes; the chains, the full
Hamming check and sketches of the shingle sets prune them before the exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import field, map_arrow, materialise

#: Segment widths of a 64-bit ring for a budget of four bits.
WIDTHS = (13, 13, 13, 13, 12)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Members of one key that are compared at once.
BLOCK = 2048
#: Members of one key whose pairs are listed at once, and among which its lead is chosen.
PAIRED, FIRST = 512, 65_536
#: Bins of a sketch, a power of two: the standard error of a similarity of 0.8 is 0.025.
SKETCH = 256
#: Members of a key, own or flipped, from which they are dealt out over pairs of chunks of half that size.
HOT = 8192
#: Bands and least hashes in each: a pair of similarity 0.8 shares none of the bands in 2 of 10,000 cases.
BANDS, LEAST = 16, 4
#: Bits in which fingerprints of similar documents may differ, and the ring segments of a byte by which chains are checked.
SIMILAR_BITS, SIMILAR_RING = 24, 8
#: Sides of a comparison that a member is on: its own key's, the others', both.
LEFT, RIGHT = 1, 2


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of so many words, lower-cased (ASCII), repeats included; of the whole of a shorter text; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; zero for none."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of word shingles under XXH64; zero for a text without words."""
    return majority_bits(np.array(shingle_hashes(text, words, seed), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """Id and ``bits``: the fingerprint as a signed 64-bit integer. Null and empty texts have zero."""
    schema = T.StructType([field(docs, id_col), T.StructField("bits", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return {id_col: batch.column(0), "bits": pa.array(made.view(np.int64))}

    return map_arrow(docs.select(id_col, text_col), run, schema)


def _starts(widths: tuple[int, ...]) -> list[int]:
    return np.concatenate([[0], np.cumsum(widths)[:-1]]).tolist()


def _segment(i: int, widths: tuple[int, ...]):
    return F.shiftrightunsigned("bits", _starts(widths)[i % len(widths)]).bitwiseAND(F.lit((1 << widths[i % len(widths)]) - 1))


def _flips(key: Column, i: int, widths: tuple[int, ...]) -> list[Column]:
    """The keys of ring segment ``i`` that differ from ``key`` in one zero bit of the second segment, set; null where the bit is set."""
    return [F.when(key.bitwiseAND(F.lit(1 << b)) == 0, key.bitwiseOR(F.lit(1 << b))) for b in range(widths[(i + 1) % len(widths)])]


def _own_keys(widths: tuple[int, ...]) -> list[Column]:
    """For each ring segment its number, its bits and those of the next segment."""
    return [F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(_segment(i, widths), 16)).bitwiseOR(_segment(i + 1, widths)) for i in range(len(widths))]


def _keyed(nodes: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(key, side, bits): for each segment the key of the node's own two segments, and those with one zero bit of the second set."""
    parts = []
    for i, key in enumerate(_own_keys(widths)):
        entries = [(key, LEFT | RIGHT), *((k, RIGHT) for k in _flips(key, i, widths))]
        parts += [F.when(k.isNotNull(), F.struct(k.alias("key"), F.lit(side).alias("side"))) for k, side in entries]
    return nodes.select(F.explode(F.array_compact(F.array(*parts))).alias("k"), "bits").select("k.key", "k.side", "bits")


def _edges_of(bits: np.ndarray, side: np.ndarray, key: int, budget: int, widths: tuple[int, ...]) -> list[tuple[int, int]]:
    """A spanning forest of the links that this key shows between its left and right members."""
    starts, rings, first = _starts(widths), len(widths), key >> 32
    parts = [(bits >> np.uint64(starts[(first + j) % rings])) & np.uint64((1 << widths[(first + j) % rings]) - 1) for j in range(rings)]
    parent = np.arange(len(bits))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    left, right = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
    for a in range(0, len(left), BLOCK):
        x = left[a : a + BLOCK]
        for b in range(0, len(right), BLOCK):
            y = right[b : b + BLOCK]
            run, ok = np.zeros((len(x), len(y)), np.uint8), None
            for j in range(1, rings):  # chains from this segment: their sums stay within l * budget / segments
                run += np.bitwise_count(parts[j][x][:, None] ^ parts[j][y][None, :])
                within = run * rings <= (j + 1) * budget
                ok = within if ok is None else ok & within
                if not ok.any():
                    break
            ok &= bits[x][:, None] != bits[y][None, :]
            for i, k in zip(*np.nonzero(ok), strict=True):
                r, s = root(int(x[i])), root(int(y[k]))
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    edges.append((int(x[i]), int(y[k])))
    return edges


def by_group(batches: Iterator[pa.RecordBatch], keys: int, work) -> Iterator[pa.RecordBatch]:
    """``work`` on each run of rows with equal values of the first ``keys`` columns (of 64-bit integers); rows come sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        columns = [held.column(i).to_numpy() for i in range(keys)]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if len(changed):
            yield from work(held.slice(0, int(changed[-1])).combine_chunks(), np.concatenate([[0], changed]))
            held = held.slice(int(changed[-1]))
    if held is not None and len(held):
        yield from work(held.combine_chunks(), np.array([0, len(held)]))


def _linker(budget: int, widths: tuple[int, ...]):
    """Of (key, pair, side, bits) sorted by key and pair: edges between fingerprints."""

    def edges(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, sides, bits, found = table["key"].to_numpy(), table["side"].to_numpy(), table["bits"].to_numpy().view(np.uint64), []
        lone = np.diff(cuts) < 2
        for a, b in zip(cuts[:-1][~lone].tolist(), cuts[1:][~lone].tolist(), strict=True):
            if (sides[a:b] & LEFT).any():
                own = bits[a:b]
                found += [(own[i], own[j]) for i, j in _edges_of(own, sides[a:b], int(keys[a]), budget, widths)]
        if found:
            pairs = np.sort(np.array(found, np.uint64).view(np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return lambda batches: by_group(batches, 2, edges)


def _hot_keys(nodes: DataFrame, widths: tuple[int, ...], hot: int) -> DataFrame:
    """(key, lefts, rights): in how many chunks each side of a key with more than ``hot`` members is dealt out.

    A key's members are its own and those of the at most 16 keys one bit below it, so one with more than ``hot`` has
    one of more than a 32nd among them: only what those hold is counted, and the rest is allowed for.
    """
    rings, few = len(widths), max(1, hot // 32)
    counted = nodes.select(F.explode(F.array(*_own_keys(widths))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    heavy = counted.where(F.col("members") > few)
    flips = F.array_compact(F.flatten(F.array(*[F.when(F.shiftright("key", 32) == i, F.array(*_flips(F.col("key"), i, widths))).otherwise(F.array().cast("array<long>")) for i in range(rings)])))
    reached = heavy.select("key", F.col("members").alias("own"), F.col("members").alias("all")).unionAll(heavy.select(F.explode(flips), F.lit(0).cast("long"), "members"))
    summed = reached.groupBy("key").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).where(F.col("all") > hot // 2)
    half = F.lit(max(1, hot // 2))
    return summed.select("key", F.greatest(F.lit(1), F.ceil((F.col("own") + few) / half)).cast("long").alias("lefts"), F.greatest(F.lit(1), F.ceil((F.col("all") + 17 * few) / half)).cast("long").alias("rights"))


def links(nodes: DataFrame, budget: int = 4, widths: tuple[int, ...] = WIDTHS, hot: int = HOT) -> DataFrame:
    """Edges (a < b) that connect all ``nodes`` (distinct ``bits``) within ``budget`` bits of each other.

    A key that may have more than ``hot`` members, its own or flipped ones, is split: each side is dealt to chunks, and
    each pair of chunks is a task's work of bounded memory, so that no link is lost and no task holds the whole key.
    """
    if len(widths) != budget + 1 or sum(widths) != 64 or max(widths) > 16:
        raise ValueError("expected budget + 1 segments of at most 16 bits that make 64")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    large = materialise(_hot_keys(nodes, widths, hot), "hot_keys")
    keyed, whole = _keyed(nodes, widths), F.lit(0).cast("long")
    if large.isEmpty():
        dealt = keyed.select("key", whole.alias("pair"), "side", "bits")
    else:
        left, right = F.pmod(F.xxhash64("bits"), F.col("lefts")), F.pmod(F.xxhash64("bits"), F.col("rights"))
        as_left = F.transform(F.sequence(whole, F.col("rights") - 1), lambda j: F.struct((left * F.col("rights") + j).alias("pair"), (F.lit(LEFT) + F.when(j == right, RIGHT).otherwise(0)).alias("side")))
        as_right = F.transform(F.sequence(whole, F.col("lefts") - 1), lambda i: F.struct((i * F.col("rights") + right).alias("pair"), F.lit(RIGHT).alias("side")))
        cells = F.when(F.col("lefts").isNull(), F.array(F.struct(whole.alias("pair"), F.col("side"))))
        own = F.array_union(as_left, F.filter(as_right, lambda c: c["pair"] != left * F.col("rights") + right))
        cells = cells.when(F.col("side") == RIGHT, as_right).otherwise(own)
        dealt = keyed.join(large, "key", "left").select("key", F.explode(cells).alias("c"), "bits").select("key", "c.pair", "c.side", "bits")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_linker(budget, widths), schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the component's smallest node.

    Alternates large-star and small-star steps until nothing changes; each step is written to shared storage.
    Rounds grow with the logarithm of the component size, and a step never holds a neighbourhood in memory.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("hub"), F.col("a").alias("low"))
        low = down.groupBy("hub").agg(F.min("low").alias("least"))
        small = down.join(low, "hub").select(F.col("least").alias("a"), F.col("low").alias("b")).unionAll(low.select(F.col("least").alias("a"), F.col("hub").alias("b")))
        now = materialise(small.where("a <> b").distinct(), "edges")
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """Id, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` (the smallest id reachable), a row for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Null ids stay null and never
    name a component unless it holds no other id. Rows with equal ids are rows of their own. An empty table gives
    an empty result. Other columns are ignored.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = materialise(marked.groupBy("bits").agg(F.min(id_col).alias("least_id")), "nodes")
    member = materialise(components(links(nodes.select("bits"), budget)), "members")
    named = nodes.join(member.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "least_id", F.coalesce("root", "bits").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(named.join(least, "root").select("bits", "component_id"), "classes")
    return marked.join(classes, "bits").select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bands: int = BANDS, least: int = LEAST, seed: int = 42) -> list[int]:
    """A signed 64-bit key for each band of least hashes; none for a text without words."""
    if not len(hashes):
        return []
    by = np.random.default_rng(seed).integers(0, 1 << 63, bands * least, np.uint64) * np.uint64(2) + np.uint64(1)
    lowest = None
    for a in range(0, len(hashes), 4096):
        mixed = hashes[a : a + 4096, None] * by  # a product's high bits, mixed once more, order the shingles anew for each function
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        own = mixed.min(axis=0)
        lowest = own if lowest is None else np.minimum(lowest, own)
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - (1 << 63) for i, part in enumerate(lowest.reshape(bands, least))]


def chained(x: np.ndarray, y: np.ndarray, budget: int = SIMILAR_BITS) -> np.ndarray:
    """For pairs of fingerprints whether they are within the budget: some segment from which all chains are, then all bits."""
    ok = np.zeros(len(x), bool)
    octets = np.bitwise_count((x ^ y).view(np.uint8).reshape(-1, SIMILAR_RING))
    for start in range(SIMILAR_RING):
        run, sound = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for length in range(1, SIMILAR_RING + 1):
            run += octets[:, (start + length - 1) % SIMILAR_RING]
            sound &= run * SIMILAR_RING <= length * budget
        ok |= sound
    return ok


_pair = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of ``SKETCH`` bins of the hash range: of its least hash, never 0; 0 for a bin without any."""
    out = np.zeros(SKETCH, np.uint8)
    if len(hashes):
        ordered = np.sort(hashes)
        bins = (ordered >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[bins[first]] = 1 + (ordered[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255)
    return out.tobytes()


def may_be_similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """For pairs of sketches whether the share of equal bins is no more than 4.5 standard errors below ``least``."""
    out = np.empty(len(x), bool)
    for a in range(0, len(x), 8192):
        p, q = x[a : a + 8192], y[a : a + 8192]
        some = np.maximum(((p | q) > 0).sum(1), 1)
        same = ((p == q) & (p > 0)).sum(1)
        out[a : a + 8192] = same / some >= least - 4.5 * np.sqrt(least * (1 - least) / some)
    return out


_shared = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bits", T.LongType()), T.StructField("lead", T.BinaryType()), T.StructField("lead_bits", T.LongType())])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node, bits) sorted by key and node, for keys with two nodes or more: each node beside the key's lead.

    The lead is the node nearest to the majority of the fingerprints, which of a text and its variants is the text. It is
    chosen among the first ``FIRST`` nodes of a key; what follows is only put beside it, so a key of any size streams.
    """
    held: list[pa.RecordBatch] = []
    rows, key, lead = 0, None, None

    def beside(part: pa.Table) -> pa.RecordBatch:
        n = len(part)
        return pa.RecordBatch.from_arrays([part["key"].combine_chunks(), part["node"].combine_chunks(), part["bits"].combine_chunks(), pa.array([lead[0]] * n, pa.binary()), pa.array(np.full(n, lead[1], np.int64))], _shared.names)

    def choose() -> Iterator[pa.RecordBatch]:
        nonlocal lead, held, rows
        part = pa.Table.from_batches(held)
        held, rows = [], 0
        if len(part) > 1 or lead:
            if not lead:
                bits = part["bits"].to_numpy()
                middle = np.uint64(majority_bits(bits.view(np.uint64)))
                at = int(np.argmin(np.bitwise_count(bits.view(np.uint64) ^ middle)))
                lead = (part["node"][at].as_py(), int(bits[at]))
            yield beside(part)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if key is not None and keys[a] != key:
                if held:
                    yield from choose()
                lead = None
            key = int(keys[a])
            held.append(batch.slice(a, b - a))
            rows += b - a
            if rows >= FIRST:
                yield from choose()
    if held:
        yield from choose()


def _chained_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, bits, lead, lead_bits): the pairs of lead and node that the chains let through, the lesser first."""
    for batch in batches:
        x, y = (batch.column(c).to_numpy().view(np.uint64) for c in ("bits", "lead_bits"))
        kept = pa.array(np.flatnonzero(chained(x, y)))
        one, two = batch.column("lead").take(kept).to_pylist(), batch.column("node").take(kept).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(list(map(min, one, two)), pa.binary()), pa.array(list(map(max, one, two)), pa.binary())], _pair.names)


def _across(least: float):
    """Of (key, cell, node, bits, sketch, keys, shingles, root, side, lead) sorted by key and cell: a spanning forest of the
    links between left and right nodes with different roots, without the lead's, which were looked at before.

    A pair is looked at under the first key that its nodes share. Chains, then sketches, then the exact similarity decide.
    """

    def links(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits, sides, leads = table["bits"].to_numpy().view(np.uint64), table["side"].to_numpy(), table["lead"].to_numpy(zero_copy_only=False)
        roots, nodes, own_key = table["root"].combine_chunks().dictionary_encode().indices.to_numpy(), table["node"].combine_chunks(), table["key"].to_numpy()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        sets = table["shingles"].combine_chunks()
        begins, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        parent = {r: r for r in np.unique(roots).tolist()}

        def root(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left, right = a + np.flatnonzero(sides[a:b] & LEFT), a + np.flatnonzero(sides[a:b] & RIGHT)
            for s in range(0, len(left), PAIRED):
                for t in range(0, len(right), PAIRED):
                    i, j = left[s : s + PAIRED], right[t : t + PAIRED]
                    at, to = np.nonzero((roots[i][:, None] != roots[j][None, :]) & ~leads[i][:, None] & ~leads[j][None, :])
                    i, j = i[at], j[to]
                    for kept in (lambda i, j: chained(bits[i], bits[j]), lambda i, j: keys[i, np.argmax(keys[i] == keys[j], axis=1)] == own_key[a], lambda i, j: may_be_similar(sketches[i], sketches[j], least)):
                        ok = kept(i, j)
                        i, j = i[ok], j[ok]
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        p, q = root(int(roots[x])), root(int(roots[y]))
                        if p == q or (x > y and sides[x] & sides[y] == LEFT | RIGHT):
                            continue
                        one, two = values[begins[x] : begins[x + 1]], values[begins[y] : begins[y + 1]]
                        if min(len(one), len(two)) < least * max(len(one), len(two)):
                            continue
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if both >= least * (len(one) + len(two) - both):
                            parent[max(p, q)] = min(p, q)
                            found.append((x, y))
        if found:
            one, two = nodes.take(pa.array([x for x, _ in found])).to_pylist(), nodes.take(pa.array([y for _, y in found])).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(min, one, two)), pa.binary()), pa.array(list(map(max, one, two)), pa.binary())], _pair.names)

    return lambda batches: by_group(batches, 2, links)


def _node(text: str | None) -> bytes:
    """A 128-bit name for all texts with the same words."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()))


def similar_documents(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, least: float = 0.8, seed: int = 42, hot: int = HOT, pick=None) -> DataFrame:
    """Id and ``component_id`` (the smallest id reachable over pairs of similarity ``least``), a row for each row of ``docs``.

    The similarity is Jaccard's, of the sets of ``words``-word shingles, lower-cased (ASCII); a text with fewer words is
    one shingle. Null, empty and blank texts are equal texts. Equal texts are one node, whatever their number; very long
    texts are compared whole. Ids must be unique and not null. An empty table gives an empty result. Other columns are
    ignored.

    Nodes that share a band are first compared with the band's lead, the node in their middle; then, of what is still in
    different components, every two of a band: those pairs leave a task only if the chains, and then sketches of their
    shingle sets, let them through. Links are only pairs with the exact similarity. ``pick`` maps the texts of the rows with some ids
    (a column of that name) by a function to a schema, where the caller knows a cheaper way than a join.
    """
    pick = pick or (lambda ids, function, schema: map_arrow(docs.join(ids, id_col, "left_semi").select(text_col), function, schema))
    mark_schema = T.StructType([field(docs, id_col, "id"), T.StructField("node", T.BinaryType()), T.StructField("bits", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def mark(batch: pa.RecordBatch) -> dict:
        nodes, bits, sketches, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            nodes.append(_node(text))
            hashes = np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))
            bits.append(majority_bits(hashes))
            sketches.append(sketch(hashes))
            keys.append(band_keys(hashes, seed=seed))
        return {"id": batch.column(0), "node": pa.array(nodes, pa.binary()), "bits": pa.array(np.array(bits, np.uint64).view(np.int64)), "sketch": pa.array(sketches, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}

    set_schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def shingled(batch: pa.RecordBatch) -> dict:
        texts = batch.column(0).to_pylist()
        sets = [np.unique(np.array(shingle_hashes(t, words, seed), np.uint64)).view(np.int64) for t in texts]
        return {"node": pa.array([_node(t) for t in texts], pa.binary()), "shingles": pa.array(sets, pa.list_(pa.int64()))}

    marked = materialise(map_arrow(docs.select(id_col, text_col), mark, mark_schema), "marked")
    nodes = materialise(marked.groupBy("node").agg(F.min("id").alias("least_id"), F.min("bits").alias("bits"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), "nodes")
    each = nodes.select(F.explode("keys").alias("key"), "node", "bits")
    shared = materialise(each.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_led, _shared), "shared")
    led = materialise(shared.where("node <> lead").select("node", "bits", "lead", "lead_bits").distinct().mapInArrow(_chained_pairs, _pair).distinct(), "led")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The shingle sets of some nodes, made of their texts."""
        ids = wanted.join(nodes.select("node", "least_id"), "node").select(F.col("least_id").alias(id_col))
        return materialise(pick(ids, shingled, set_schema), "shingles")

    sets = sets_of(led.select(F.col("a").alias("node")).unionAll(led.select(F.col("b").alias("node"))).distinct())
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links_ = materialise(led.join(left, "a").join(right, "b").where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")
    found = materialise(components(links_), "members")
    placed = shared.join(found, "node", "left").select("key", "node", "bits", F.coalesce("root", "node").alias("root"), (F.col("node") == F.col("lead")).alias("lead"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high AND n > 2").select("key", "n")
    rest = materialise(placed.join(open_keys, "key"), "rest")
    if not rest.isEmpty():
        chunks = F.ceil(F.col("n") / F.lit(max(1, min(PAIRED, hot // 2))))  # of few nodes, since they bring their sets
        own = F.pmod(F.xxhash64("node"), chunks)
        # a key's members are dealt to chunks, and every two chunks, and each with itself, are a task's work
        cells = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.struct((F.least(own, j) * chunks + F.greatest(own, j)).alias("cell"), F.when(own == j, LEFT | RIGHT).when(own < j, LEFT).otherwise(RIGHT).alias("side")))
        brought = nodes.select("node", "sketch", "keys").join(sets_of(rest.select("node").distinct()), "node")
        carried = ("node", "bits", "sketch", "keys", "shingles", "root")
        dealt = rest.join(brought, "node").select("key", F.explode(cells).alias("c"), *carried, "lead").select("key", "c.cell", *carried, "c.side", "lead")
        across = materialise(dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_across(least), _pair).distinct(), "pairs")
        if not across.isEmpty():
            found = materialise(components(links_.unionAll(across)), "members")

    named = nodes.select("node", "least_id").join(found, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least_ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(named.join(least_ids, "root").select("node", "component_id"), "classes")
    return marked.join(classes, "node").select(F.col("id").alias(id_col), "component_id")
