"""Language identification with hyperdimensional profiles.

Each letter has a random vector of plus and minus ones. A letter n-gram is the product (binding) of its letters'
vectors, each rotated (permuted) by its place; a text is the sum (bundle) of its n-grams. A language's prototype
bundles the profiles of its training texts, each text with the same weight; a text gets the language whose
prototype has the largest cosine with it. Weights are integers, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import SLICE, crc32_remainder, field, map_arrow

DIMENSIONS = 1024
ORDER = 3
UNKNOWN = "und"
#: Weight of one training text, shared by its n-grams; 2 ** 39 texts of a language sum up in 64 bits.
UNIT = 1 << 24
#: n-grams whose vectors a worker keeps, a byte for each dimension.
REMEMBER = 1 << 15
#: Characters of a text that are cut into n-grams at once.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None, order: int = ORDER, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the lower-cased text's n-grams; every run of other characters is one blank. Empty if no letter.

    Texts are cut into pieces of ``piece`` characters whose counts are added, so that very long ones need little more
    memory than they take themselves; a piece begins with the last ``order`` - 1 characters of the one before.
    """
    lowered, table, before, found, lettered = (text or "").lower(), _letter_table(), np.array([32], np.int64), [], False
    for at in range(0, len(lowered) + 1, piece):
        points = np.frombuffer(lowered[at : at + piece].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[points]
        lettered |= bool(letter.any())
        last = [[32]] if at + piece > len(lowered) else []
        points = np.concatenate([before, np.where(letter, points, 32), *last]).astype(np.int64)
        blank = points == 32
        points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
        codes = np.zeros(max(0, len(points) - order + 1), np.int64)
        for i in range(order):
            codes = (codes << 21) | points[i : i + len(codes)]
        found.append(np.unique(codes, return_counts=True))
        before = points[-(order - 1) :] if order > 1 else points[:0]
    if not lettered:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


class Vectors:
    """n-gram vectors, made when first asked for."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 42):
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((REMEMBER, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[point] = (2 * np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions) - 1).astype(np.int8)
        return self.letters[point]

    def _bound(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.order):
            out *= np.roll(self.letter((code >> (21 * place)) & 0x1FFFFF), place)
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code (at most ``REMEMBER`` of them)."""
        rows = self.rows
        if len(rows) + len(codes) > REMEMBER:
            rows.clear()
        at = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            row = rows.get(code)
            if row is None:
                row = rows[code] = len(rows)
                self.table[row] = self._bound(code)
            at[i] = row
        return self.table[at]

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of n-gram vectors, exact in 64-bit integers or floats."""
        total = np.zeros(self.dimensions, weights.dtype)
        for a in range(0, len(codes), 4096):
            total += weights[a : a + 4096] @ self.of(codes[a : a + 4096]).astype(weights.dtype)
        return total


_made: dict[tuple, Vectors] = {}


def vectors(*args: int) -> Vectors:
    if args not in _made:
        _made.clear()
        _made[args] = Vectors(*args)
    return _made[args]


def fit_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 42) -> dict[str, np.ndarray]:
    """A unit vector for each language of ``docs``, of all rows with a language and a letter.

    A task sends one vector for each language, whatever its rows. The languages of a corpus are few; the result is
    theirs alone.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = vectors(dimensions, order, seed), TaskContext.get().partitionId() % 256
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, dict[int, int]] = {}

        def fold(lang: str) -> None:
            own = weights.pop(lang)
            codes = np.fromiter(own.keys(), np.int64, len(own))
            sums[lang] = sums.get(lang, 0) + made.bundle(codes, np.fromiter(own.values(), np.int64, len(own)))

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = ngrams(text, order)
                if lang is None or not len(codes):
                    continue
                own = weights.setdefault(lang, {})
                for code, weight in zip(codes.tolist(), (counts * UNIT // counts.sum()).tolist(), strict=True):
                    own[code] = own.get(code, 0) + weight
                if len(own) > 500_000:
                    fold(lang)
        for lang in list(weights):
            fold(lang)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([part] * len(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        rows = table["sums"].combine_chunks()
        total = rows.values.to_numpy().reshape(-1, dimensions).sum(axis=0)
        return pa.table({"lang": table["lang"][:1], "part": pa.array([0]), "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = docs.select(text_col, lang_col).where(F.col(lang_col).isNotNull()).mapInArrow(run, schema)
    once = parts.groupBy("lang", "part").applyInArrow(add, schema)
    rows = once.groupBy("lang").applyInArrow(add, schema).select("lang", "sums").collect()
    found = {r["lang"]: np.array(r["sums"], np.float64) for r in rows}
    return {lang: v / n for lang, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 42) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` (the cosine, negative ones as 0), a row for each row of ``docs``.

    Null, empty and letterless texts are ``und`` with score 0, as is everything when there is no prototype. A text with
    letters gets a language: of equal cosines, or where its n-grams cancel out, the alphabetically first. Very long
    texts are looked at whole. Null and repeated ids pass through; an empty table gives an empty result. Other columns
    are ignored.
    """
    schema = T.StructType([field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    predict = _predictor(prototypes, dimensions, order, seed)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = predict(batch.column(1).to_pylist())
        return {id_col: batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_arrow(docs.select(id_col, text_col), run, schema)


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], least_score: float, text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, whole and unshuffled, that have a language with at least ``least_score``; without prototypes none."""
    predict = _predictor(prototypes, dimensions, order, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                names, scores = predict(batch.column(text_col).to_pylist())
                yield batch.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def _predictor(prototypes: dict[str, np.ndarray], dimensions: int, order: int, seed: int):
    """From a list of texts to their languages and scores."""
    langs = sorted(prototypes)
    known = np.array([prototypes[x] for x in langs], np.float32).reshape(len(langs), dimensions)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        made, names, scores = vectors(dimensions, order, seed), [], []
        for text in texts:
            codes, counts = ngrams(text, order)
            if not len(codes) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            profile = made.bundle(codes, counts.astype(np.float32))
            cosines = known @ profile / max(1.0, float(np.linalg.norm(profile)))
            best = int(np.argmax(cosines))
            names.append(langs[best])
            scores.append(min(1.0, max(0.0, float(cosines[best]))))
        return names, scores

    return predict


def held_out_fold(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id's text is divisible by ``folds``; false for a null id."""
    return F.coalesce(crc32_remainder(F.col(id_col), folds) == 0, F.lit(False))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learns from rows outside the held-out fold and predicts every row: id, ``held_out``, ``lang_pred``, ``score``."""
    learn = docs.where(crc32_remainder(F.col(id_col), folds) != 0)
    return identify(docs, fit_prototypes(learn, text_col, lang_col), id_col, text_col).withColumn("held_out", held_out_fold(id_col, folds))
