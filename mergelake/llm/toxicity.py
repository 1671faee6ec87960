"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps look-alike letters, accents, digits and signs that stand for letters, and stretched letters to one
form, for the lexicon and the text alike. The lexicon holds words and word beginnings that labelled toxic
documents have far more often than clean ones; weights are log odds. Matches inside exception phrases do not
count: some are given, others are learned, as the pairs of words around a match that clean labelled documents have
and toxic ones have not. A document's score is a logistic function of its matched weight and of that weight per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import crc32_remainder, field, map_arrow, materialise

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
# Phrases whose words are meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid mistake", "scum line", "pond scum")

#: Labelled documents from which the lexicon is learned at most.
SAMPLE = 20_000
#: Clean documents that must have a phrase for it to be an exception, and how much likelier they must be to have it than toxic ones.
PHRASE_DOCS, PHRASE_ODDS = 3, 2.0
#: Length of word beginnings.
BEGINNINGS = range(4, 9)
_not_letters = re.compile(r"[\W\d_]+")
_stretched = re.compile(r"(.)\1\1+")
_signs = re.compile(r"(?<=\w)[@$!|€](?=[@$!|€]*\w)|(?<!\S)[@$](?=\w)")


def _table() -> dict[int, str | None]:
    """Fixed look-alikes, digits, l as i, and by rule: accented and styled letters by decomposition, marks and invisible characters to nothing."""
    made: dict[int, str | None] = {}
    for point in [*range(0x80, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x2070), *range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), 0xAD, 0xFEFF]:
        char = chr(point)
        if unicodedata.category(char) in ("Mn", "Cf"):
            made[point] = None
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
        if plain != char and plain.isascii() and plain.isalnum():
            made[point] = plain
    made |= {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(k): v for k, v in DIGITS.items()}
    made = {k: v and v.translate({ord(d): x for d, x in DIGITS.items()}).replace("l", "i") for k, v in made.items()}
    return made | {ord("l"): "i"}


_FOLD = _table()


def fold(text: str | None) -> str:
    """Words of the folded text with one blank before, between and after them."""
    text = (text or "").lower()
    if _signs.search(text):
        text = _signs.sub(lambda m: SIGNS[m[0]], text)
    return f" {_not_letters.sub(' ', _stretched.sub(r'\1', text.translate(_FOLD))).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries are folded: " word " or " beginning"; coefficients: of 1, the weight's logarithm, and that per 100 words."""

    weights: dict[str, float]
    coefficients: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def __hash__(self) -> int:
        return hash((frozenset(self.weights.items()), self.coefficients, self.exceptions))

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in map(fold, self.exceptions):
            made.add_word(phrase, (len(phrase), None))
        if len(made):
            made.make_automaton()
        return made


def measure(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """Matched weight outside exception phrases, and the number of words; in time linear in text and matches."""
    folded = fold(text)
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if not len(automaton) or not words:
        return 0.0, words
    spared, found = [], []
    for end, (length, weight) in automaton.iter(folded):
        (spared if weight is None else found).append((end - length + 1, end, weight))
    if not spared:
        return sum(w for _, _, w in found), words
    total, at, reach = 0.0, 0, -1
    spared.sort(key=lambda x: x[0])
    for begin, end, weight in sorted(found, key=lambda x: x[0]):
        while at < len(spared) and spared[at][0] <= begin:  # of the phrases that begin by then the one that reaches furthest
            reach = max(reach, spared[at][1])
            at += 1
        if end > reach:
            total += weight
    return total, words


def _around(automaton: ahocorasick.Automaton, folded: str) -> set[str]:
    """The pairs of words before and after each match."""
    out: set[str] = set()
    for end, (length, _) in automaton.iter(folded):
        begin = end - length + 1
        after = end if folded[end] == " " else folded.index(" ", end)
        if begin:
            out.add(folded[folded.rindex(" ", 0, begin) : after + 1])
        if after + 1 < len(folded):
            out.add(folded[begin : folded.index(" ", after + 1) + 1])
    return out


def choose_exceptions(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[str, ...]:
    """Phrases from (toxic, clean) document counts: enough clean documents and large enough log odds against toxicity."""
    return tuple(sorted(p for p, (t, c) in counts.items() if c >= PHRASE_DOCS and np.log((c + 0.5) / (clean + 1)) - np.log((t + 0.5) / (toxic + 1)) >= PHRASE_ODDS))


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _candidates(folded: str) -> set[str]:
    out: set[str] = set()
    for word in set(folded.split()):
        if len(word) >= BEGINNINGS.start:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in BEGINNINGS if n <= len(word))
        elif len(word) == 3:
            out.add(f" {word} ")
    return out


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int, word_share: float = 0.004, beginning_share: float = 0.02, word_odds: float = 2.5, beginning_odds: float = 4.5) -> dict[str, float]:
    """Entries from (toxic, clean) document counts: enough toxic documents and large enough log odds.

    Beginnings must be commoner and purer than words. Of beginnings with nearly the same documents the longest is
    taken; entries under a chosen beginning are left out.
    """
    chosen: dict[str, float] = {}
    longest: dict[str, int] = {}
    for entry, (t, _) in counts.items():
        longest[entry[:-1]] = max(longest.get(entry[:-1], 0), t)
    for entry in sorted(counts, key=lambda e: (len(e.rstrip()), e.endswith(" "), e)):
        t, c = counts[entry]
        share, least_odds = (word_share, word_odds) if entry.endswith(" ") else (beginning_share, beginning_odds)
        if t < max(3, share * toxic) or longest.get(entry, 0) >= 0.95 * t or any(entry[:n] in chosen for n in range(2, len(entry))):
            continue
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if odds >= least_odds:
            chosen[entry] = float(round(odds, 6))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learns from at most ``sample`` labelled documents (labels 0 and 1), those whose ids have the smallest hashes.

    The sample of ids is drawn from the labels alone and is the only thing broadcast, so its size has a proven bound and
    texts outside it are never shuffled; of documents with the same id one text is taken. What comes to the driver
    is bounded by the sample too: entries that enough of its toxic documents have, and two numbers for each.
    """
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    drawn = materialise(wanted.orderBy(F.xxhash64("id"), "id", "label").limit(sample), "drawn")
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    rows = materialise(texts.join(F.broadcast(drawn), F.col("own") == F.col("id")).groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label"), "labelled")
    toxic, clean = (int(x or 0) for x in rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not toxic or not clean:
        return Lexicon({}, (-4.0 if not toxic else 4.0, 0.0, 0.0))
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict | None:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for entry in _candidates(fold(text)):
                counts.setdefault(entry, [0, 0])[1 - label] += 1
        return {"entry": pa.array(list(counts), pa.string()), "toxic": pa.array([x[0] for x in counts.values()], pa.int64()), "clean": pa.array([x[1] for x in counts.values()], pa.int64())}

    each = map_arrow(rows.select("text", "label"), run, schema)
    summed = each.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = summed.where(F.col("toxic") >= max(3.0, 0.004 * toxic)).where(F.col("toxic") * clean > F.col("clean") * toxic * 2).collect()
    weights = choose({r["entry"]: (r["toxic"], r["clean"]) for r in counted}, toxic, clean)
    exceptions = (*EXCEPTIONS, *_learned_exceptions(rows, Lexicon(weights, (0.0, 0.0, 0.0), ()), toxic, clean))
    measured = map_arrow(rows.select("text", "label"), _measurer(Lexicon(weights, (0.0, 0.0, 0.0), exceptions)), T.StructType([T.StructField("label", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("words", T.LongType())]))
    table = measured.toArrow()
    x, y = _features(table["weight"].to_numpy(), table["words"].to_numpy()), table["label"].to_numpy().astype(float)
    return Lexicon(weights, tuple(float(round(b, 9)) for b in _logistic(x, y)), exceptions)


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> tuple[str, ...]:
    """From the labelled sample alone; what comes to the driver are phrases that enough of its clean documents have."""
    schema = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("label", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> dict:
        made, found = automaton_of(lexicon), []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found += [(p, label) for p in (_around(made, fold(text)) if len(made) else ())]
        return {"phrase": pa.array([p for p, _ in found], pa.string()), "label": pa.array([x for _, x in found], pa.int32())}

    each = map_arrow(rows.select("text", "label"), run, schema)
    counted = each.groupBy("phrase").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("c") >= PHRASE_DOCS).collect()
    return choose_exceptions({r["phrase"]: (r["t"], r["c"]) for r in counted}, toxic, clean)


_automata: dict[Lexicon, ahocorasick.Automaton] = {}


def automaton_of(lexicon: Lexicon) -> ahocorasick.Automaton:
    """Built once in a worker, whatever the number of its batches and tasks."""
    if lexicon not in _automata:
        _automata.clear()
        _automata[lexicon] = lexicon.automaton()
    return _automata[lexicon]


def _measurer(lexicon: Lexicon):
    def run(batch: pa.RecordBatch) -> dict:
        made = automaton_of(lexicon)
        found = [measure(made, t) for t in batch.column(0).to_pylist()]
        return {"label": batch.column(1), "weight": pa.array([x[0] for x in found], pa.float64()), "words": pa.array([x[1] for x in found], pa.int64())}

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return b


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Id, ``score`` (0 to 1, higher: likelier toxic), ``predicted`` (1 from ``threshold``), ``weight``, ``n_words``, a row for each row of ``docs``.

    Null, empty and wordless texts match nothing and have the score of a text without matches. Very long texts are
    matched whole, in time linear in their length. Only the text is looked at; null and repeated ids pass through. An
    empty table gives an empty result. Other columns are ignored.
    """
    schema = T.StructType([field(docs, id_col), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(lexicon)
        for batch in batches:
            found = [measure(automaton, t) for t in batch.column(1).to_pylist()]
            weight, words = np.array([x[0] for x in found], float), np.array([x[1] for x in found], np.int64)
            p = 1 / (1 + np.exp(-np.clip(_features(weight, words) @ np.array(lexicon.coefficients), -30, 30)))
            p = np.round(p, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(weight), pa.array(words)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Learns from labelled rows outside the held-out fold (crc32 of the id's text modulo ``folds`` is ``held``) and scores every row."""
    lexicon = fit(docs, labels.where(crc32_remainder(F.col(id_col), folds) != held), id_col, text_col, label_col, sample)
    return score(docs, lexicon, id_col, text_col).withColumn("held_out", F.coalesce(crc32_remainder(F.col(id_col), folds) == held, F.lit(False)))
