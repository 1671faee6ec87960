"""Mixing sources to target weights by entropy balancing.

Every document starts at rate one. For each source, the rates that satisfy its token constraint with the least
relative entropy are exponential in the document's size, exp(multiplier * size / mean size), held at ``most``.
The convex dual has one multiplier for each source; all are found together by Newton steps, each a distributed
aggregate over the histogram of (source, size), added up in whole units, so that no order of addition shows. Rates
are then rounded into whole copies, carrying each document's remainder on to the next smaller one. Rows with equal
source, id and size are one entry with a count, however many they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.llm.common import WORD, field, map_arrow, materialise, release, scratch_scope

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that are rounded together.
ROUND_TOGETHER = 4096
#: Largest relative distance of a source's expected tokens from its target.
TOLERANCE = 1e-6
#: Rates and their slopes are added up in units of this fraction.
UNITS = 1 << 50
#: Newton steps after which balancing is taken for failed.
ROUNDS = 200
#: Copies of one entry that a row of the result's first expansion stands for.
RUN = 4096


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, ``mix_source`` and ``size`` in words; null texts have none."""
    schema = T.StructType([field(docs, id_col), field(docs, source_col, "mix_source"), T.StructField("size", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        sizes = pc.fill_null(pc.count_substring_regex(batch.column(2), WORD), 0)
        return {id_col: batch.column(0), "mix_source": batch.column(1), "size": sizes.cast(pa.int64())}

    return map_arrow(docs.select(id_col, source_col, text_col), run, schema)


def _placed(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, by code point of ``mix_source``, null last: sorted by range, counted part by part, no task holds all."""
    ordered = sources.repartitionByRange(F.col("mix_source").isNull(), "mix_source").sortWithinPartitions(F.col("mix_source").isNull(), "mix_source")
    numbered = materialise(ordered.withColumn("seq", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("seq", 33)
    # an entry for each of a sort's partitions, whose number is bounded by spark.sql.shuffle.partitions
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    start = F.element_at(F.create_map(*[F.lit(x) for (p, _), b in zip(counts, begins, strict=False) for x in (p, b)]), part) if counts else F.lit(0)
    return numbered.withColumn("place", start + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))).drop("seq")


def capped_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (mix_source, source_size, ...): all sizes shared by weight, at most ``most`` times a source's own.

    What capped sources leave is shared again by weight among the others until none is above. Sums are of whole numbers
    and decimals, so they do not depend on the order of addition.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialise(_placed(sources).withColumn("weight", weight).drop("place"), "weighed")
    exact = F.col("weight").cast("decimal(20,6)")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, share = None, total / max(1e-300, float(ranked.agg(F.sum(exact)).first()[0] or 0))
    while share != level:
        level = share
        capped = F.col("weight") * level > most * F.col("source_size")
        full, rest = ranked.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, exact))).first()
        if not rest:
            break
        share = max(level, (total - most * float(full or 0)) / float(rest))
    return ranked.withColumn("target", F.least(F.col("weight") * float(level or 0), most * F.col("source_size")).cast("double")).drop("weight")


def _tilted(most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.col("multiplier") * F.col("size") / F.col("mean")))


def _total(per_token: Column) -> Column:
    """Sum of ``per_token`` over all tokens, in whole units: every order of addition gives the same digits."""
    units = F.round(per_token * UNITS).cast("decimal(18,0)")
    return (F.sum((F.col("docs") * F.col("size")).cast("decimal(20,0)") * units) / UNITS).cast("double")


def balance(histogram: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``multiplier`` to ``targets``: safeguarded Newton steps on the dual, for all sources at once.

    ``histogram``: mix_source, size, docs. A step that leaves the bracket of its source is replaced by its middle. A
    dual that has not come within ``tolerance`` after ``rounds`` steps is an error that names the gap.
    """
    mean = F.greatest(F.col("source_size") / F.greatest(F.col("sized"), F.lit(1)), F.lit(1e-9))
    state = targets.withColumns({"mean": mean, "multiplier": F.lit(0.0), "low": F.lit(-64.0) * F.greatest(mean, F.lit(1.0)), "high": F.lit(64.0) * mean + 2.0})
    gap_left, held = 0.0, []
    for _ in range(rounds):
        with scratch_scope() as made:
            state = materialise(state, "multipliers")
            there = state.withColumnRenamed("mix_source", "own")
            rate, x = _tilted(most), F.col("size") / F.col("mean")
            sums = (
                histogram.join(there, histogram["mix_source"].eqNullSafe(there["own"]))
                .groupBy("own")
                # slopes are relative to the size of their largest term, so that their units do not run out
                .agg(_total(rate).alias("value"), _total(F.when(rate < most, F.least(x, F.lit(2.0**16)) * rate / 2.0**10).otherwise(0.0)).alias("slope"))
                .withColumn("slope", F.col("slope") * 2.0**10)
            )
            open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
            off = F.abs(F.col("value") - F.col("target"))
            gap = F.when(open_ & (off > 0.5), off / F.col("target")).otherwise(0.0)  # half a token is near enough for any source
            measured = materialise(there.join(sums, there["own"].eqNullSafe(sums["own"]), "left").drop(sums["own"]).withColumn("gap", F.coalesce(gap, F.lit(0.0))), "dual")
        gap_left = measured.agg(F.max("gap")).first()[0] or 0.0
        if gap_left <= tolerance:
            return state
        low = F.when(F.col("value") < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("value") >= F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - (F.col("value") - F.col("target")) / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        moved = measured.withColumns({"step": F.when(F.col("gap") > tolerance, step).otherwise(F.col("multiplier")), "l": low, "h": high})
        release(held)  # what the step before last wrote
        held = made
        state = moved.select(F.col("own").alias("mix_source"), *[c for c in targets.columns if c != "mix_source"], "mean", F.col("step").alias("multiplier"), F.col("l").alias("low"), F.col("h").alias("high"))
    raise ArithmeticError(f"after {rounds} steps a source is still {gap_left:.2g} of its target away")


def copies_of(sizes: np.ndarray, rates: np.ndarray, most: int = 3, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(copies that every document of an entry has, documents of it that have one more); entries hold ``counts`` documents each.

    Each rate is rounded up or down so that the running total stays at the running expectation. Sizes must fall, so
    that what large documents leave over is made good by small ones. What one very large document leaves over beyond
    that is made good by whole copies of others, largest first.
    """
    counts = np.ones(len(sizes), np.int64) if counts is None else counts
    floor = np.floor(rates + 1e-12).astype(np.int64)
    total, carry = floor * counts, 0.0
    for i, (size, rate, low, n) in enumerate(zip(sizes.tolist(), rates.tolist(), floor.tolist(), counts.tolist(), strict=True)):
        part = rate - low
        if part > 1e-12:
            carry += part * size * n
            more = int(min(n, max(0, math.floor(carry / size + 0.5))))
            total[i] += more
            carry -= more * size
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if size and abs(carry) >= size / 2 and 0 < rates[i] < most:
            step = int(np.clip(round(carry / size), -total[i], most * n - total[i]))
            if abs(carry - step * size) < abs(carry):
                total[i] += step
                carry -= step * size
    return total // counts, total % counts


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = 3, together: int = ROUND_TOGETHER) -> DataFrame:
    """Id, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (copies times size), a row for each row of ``docs``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. Targets and rates as in the module.
    Null and empty texts have size 0 and are taken never (one that has no words changes no total); very long texts are
    counted whole and taken like any other. Rounding depends only on source, id and size, so reruns agree to the row: of
    rows with equal id and size some may get a copy more than others, always as many. Null ids stay null, and are dealt
    out by size. An empty table gives an empty result. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    sized = materialise(word_sizes(docs, id_col, text_col, source_col).withColumnRenamed(id_col, "id"), "sizes")
    histogram = materialise(sized.groupBy("mix_source", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    sources = histogram.groupBy("mix_source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum("docs").alias("all_docs"), F.sum(F.when(F.col("size") > 0, F.col("docs")).otherwise(0)).alias("sized"))
    state = balance(histogram, capped_targets(sources, weights, most), most)
    full = F.col("target") >= most * F.col("source_size")
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(full, float(most)).otherwise(_tilted(most))
    there = state.withColumnRenamed("mix_source", "own")
    entries = sized.groupBy("mix_source", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    rated = entries.join(there, entries["mix_source"].eqNullSafe(there["own"])).withColumn("rate", rate)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("all_docs") / F.lit(together)))
    dealt = rated.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), buckets))
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    out = T.StructType([T.StructField("id", id_type), *long("size", "source_size"), T.StructField("target", T.DoubleType()), *long("n", "copies", "more")])

    def rounder(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending")])
        copies, more = copies_of(table["size"].to_numpy(), table["rate"].to_numpy(), most, table["n"].to_numpy())
        return table.select([f.name for f in out.fields[:-2]]).append_column("copies", pa.array(copies)).append_column("more", pa.array(more))

    kept = dealt.select("id", "size", "source_size", "target", "n", "rate", "mix_source", "bucket")
    rounded = kept.groupBy("mix_source", "bucket").applyInArrow(rounder, out)
    # a row for each document of an entry again, in two steps, so that no row holds a list of millions
    runs = rounded.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("at", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RUN, F.col("n")) - 1)))
    copies = (F.col("copies") + F.when(F.col("at") < F.col("more"), 1).otherwise(0)).alias("copies")
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
