"""Quality rules: per-document base rules, then cross-document line frequency: lines that too many documents of a host share go."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import field, map_arrow, materialise

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
_blanks = re.compile(r"[\x20\x09-\x0D]+")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    code = ids[: n - window + 1]
    for i in range(1, window):
        code = np.unique(code * len(number) + ids[i : i + n - window + 1], return_inverse=True)[1]
    often = np.bincount(code)[code] > 1
    ends = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + window, -1)
    return int((np.cumsum(ends)[:n] > 0).sum())


def line_hash(line: str) -> int:
    """Of the line lower-cased, with blanks run together, as a signed 64-bit integer."""
    return xxhash.xxh64_intdigest(_blanks.sub(" ", line.lower()).strip(" ").encode(), 42) - (1 << 63)


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """Words, their characters, symbols, repeated lines, repeated words; distinct line hashes and the words under each."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    repeated = 0
    lines: dict[int, int] = {}
    for line in text.split("\n"):
        if not line.strip(BLANK):
            continue
        repeated += line in seen
        seen.add(line)
        key = line_hash(line)
        lines[key] = lines.get(key, 0) + len(line.encode().split())
    chars = len(text) - sum(text.count(c) for c in BLANK)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), repeated, repeated_words(words), list(lines), list(lines.values())


#: Documents of a host that may share a line. Of the 2.2 million lines of hosts in the larger check table 98 % are in one
#: document, and 1,192 in more than 25: shared passages, and the lines of groups of copies.
LEAST_DOCS = 25


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, share: float = 0.0, left_share: float = 0.5) -> DataFrame:
    """Id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``left_words``, ``kept``.

    ``base_failed``: under 50 words, or over half of them in repeated windows of three. A line (lower-cased, blanks
    run together) is above the limit if more than ``least_docs`` documents of the host have it, and more than ``share``
    of all its documents; exact copies are documents like any other. ``left_words`` are those outside such lines; a
    document with fewer than ``left_share`` of its words left is depleted and not kept. A null host is a host of its
    own. Null, empty and blank texts have no words and fail. Very long texts are measured whole, and every one of their
    lines counts. Repeated rows and ids are documents each for itself; null ids stay null. An empty table gives an empty
    result. Other columns are ignored.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([
        field(docs, id_col, "id"), field(docs, host_col, "host"), *(T.StructField(n, T.LongType()) for n in counts),
        T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("line_words", T.ArrayType(T.LongType())),
    ])

    def run(batch: pa.RecordBatch) -> dict:
        found = list(zip(*map(measure, batch.column(2).to_pylist()), strict=True))
        out = {"id": batch.column(0), "host": batch.column(1)} | {n: pa.array(found[i], pa.int64()) for i, n in enumerate(counts)}
        return out | {"lines": pa.array(found[5], pa.list_(pa.int64())), "line_words": pa.array(found[6], pa.list_(pa.int64()))}

    measured = materialise(map_arrow(docs.select(id_col, host_col, text_col), run, schema).withColumn("row", F.monotonically_increasing_id()), "quality")
    # a document's lines are distinct already, so documents are counted by counting rows, summed before they are shuffled
    above = measured.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > least_docs)
    if share > 0:
        hosts = measured.groupBy(F.col("host").alias("own")).agg(F.count(F.lit(1)).alias("all_docs"))
        above = above.join(hosts, F.col("host").eqNullSafe(F.col("own"))).where(F.col("docs") > share * F.col("all_docs"))
    above = above.select(F.col("host").alias("over_host"), F.col("line").alias("over_line"))
    each = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    gone = each.join(above, (F.col("line") == F.col("over_line")) & F.col("host").eqNullSafe(F.col("over_host")), "left_semi").groupBy("row").agg(F.sum("words").alias("gone"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    out = measured.drop("lines", "line_words", "host").join(gone, "row", "left").withColumns({"base_failed": base_failed, "left_words": left})
    return out.select(F.col("id").alias(id_col), *counts, "base_failed", "left_words", (~F.col("base_failed") & (F.col("left_words") >= left_share * F.col("n_words"))).alias("kept"))


def oracle_sql(least_docs: int = LEAST_DOCS, left_share: float = 0.5) -> str:
    """The same rules in DuckDB's SQL over ``documents``."""
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, unnest({words.format("t")}) AS word, generate_subscripts({words.format("t")}, 1) AS i FROM d),
        g AS (SELECT rid, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o] AS gram, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
        r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE third IS NOT NULL) WHERE c > 1),
        rw AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
        l AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
        lw AS (SELECT *, len({words.format("line")}) AS n, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
        ln AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM lw WHERE n > 0 GROUP BY rid),
        above AS (SELECT source, norm FROM lw WHERE n > 0 GROUP BY source, norm HAVING count(DISTINCT rid) > {least_docs}),
        gone AS (SELECT rid, sum(n) AS n FROM lw JOIN above a ON lw.norm = a.norm AND lw.source IS NOT DISTINCT FROM a.source GROUP BY rid),
        c AS (SELECT d.doc_id, CAST(len({words.format("t")}) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.dups, 0) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS gone
              FROM d LEFT JOIN rw USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN gone USING (rid)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - gone AS left_words FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, NOT base_failed AND left_words >= {left_share} * n_words AS kept FROM b"""
