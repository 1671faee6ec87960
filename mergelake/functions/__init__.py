"""Scalar functions over vectors and bit arrays, as Columns and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of longs; an error if their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("arrays of different lengths")).cast("int"))
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(same, bits))


def inner_product(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - |a.b| / (|a| |b|): the absolute inner product, so opposite vectors are near."""
    return 1 - F.abs(inner_product(a, b)) / F.sqrt(inner_product(a, a) * inner_product(b, b))


_SQL = {
    "hamming_distance": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"),
    "inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "squared_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1 - abs(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL in this session."""
    for name, (arguments, returns, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
