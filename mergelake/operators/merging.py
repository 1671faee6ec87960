"""Merge operators: how the rows of one key become one row when a table is read.

Every operator is an aggregate over the rows of a key, with ``seq`` giving their order: place of the commit in the
snapshot, then of the row in its file. "Poisoned" operators give null if any input is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, FILE = "_seq", "_commit"
BUILT_IN = ("use_last", "use_last_not_null", "sum_all", "sum_last", "joined_all_by_comma", "joined_all_by_semicolon", "joined_last_by_comma", "joined_last_by_semicolon")
_own: dict[str, Callable[[Column], Column]] = {}
#: Operators that look at the last row of each file only.
_last_of_file = {"sum_last", "joined_last_by_comma", "joined_last_by_semicolon"}


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Adds an operator: from the array of a key's values, oldest first, to the merged value."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    _own[name] = function


def known() -> list[str]:
    return sorted([*BUILT_IN, *_own])


def merged(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, T.DataType, Column | None]]) -> DataFrame:
    """One row for each key. ``columns``: name to (operator, type, condition under which a row has the column or None).

    Where the last row wins whole, it is the first of its key in a window; else each column has an aggregate of its
    own, and ``max_by`` ignores rows that lack the column. Either way a column that nobody reads is not scanned.
    """
    if all(op == "use_last" and has is None for op, _, has in columns.values()):
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(SEQ)))
        return df.withColumn("_place", last).where("_place = 1").select(*keys, *[f"`{n}`" for n in columns])
    if per_file := [n for n in columns if columns[n][0] in _last_of_file]:  # of each file only the last row counts for these
        newest = F.row_number().over(Window.partitionBy(*keys, FILE).orderBy(F.desc(SEQ)))
        df = df.withColumn("_last", newest == 1)
    aggregates = []
    for name, (op, kind, has) in columns.items():
        value, seq = F.col(f"`{name}`"), F.col(SEQ)
        if op == "use_last":
            aggregates.append(F.max_by(value, seq if has is None else F.when(has, seq)).alias(name))
            continue
        here = F.lit(True) if has is None else has
        if name in per_file:
            here = here & F.col("_last")
        # Rows that lack the column, or do not count, take no part: they are filtered per aggregate.
        aggregates.append(_filtered(op, value, seq, kind, here).alias(name))
    return df.groupBy(*keys).agg(*aggregates).select(*keys, *[f"`{n}`" for n in columns])


def _filtered(op: str, value: Column, seq: Column, kind: T.DataType, here: Column) -> Column:
    rows = F.transform(F.array_sort(F.collect_list(F.when(here, F.struct(seq.alias("s"), value.alias("v"))))), lambda x: x["v"])
    sound = F.count_if(here & value.isNull()) == 0
    if op in ("sum_all", "sum_last"):
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"sums need numbers, not {kind.simpleString()}")
        return F.when(sound, F.sum(F.when(here, value))).cast(kind)
    if op == "use_last_not_null":
        return F.max_by(value, F.when(here & value.isNotNull(), seq))
    if op.startswith("joined_") and op in BUILT_IN:
        joined = F.array_join(F.transform(rows, lambda x: x.cast("string")), "," if op.endswith("comma") else ";")
        return F.when(sound & (F.count_if(here) > 0), joined).cast(kind)
    if op in _own:
        return _own[op](rows).cast(kind)
    raise ValueError(f"unknown merge operator {op}; there are {', '.join(known())}")
