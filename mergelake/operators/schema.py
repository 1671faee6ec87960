"""Schema rules: evolution, type changes, alignment of incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType())


class SchemaError(ValueError):
    """A write or a change of schema that the rules refuse."""


def find(schema: T.StructType, name: str) -> T.StructField | None:
    """Names differ in more than case."""
    return next((f for f in schema.fields if f.name.lower() == name.lower()), None)


def check_names(schema: T.StructType) -> None:
    names = [f.name.lower() for f in schema.fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise SchemaError(f"columns differ in case only, or repeat: {', '.join(twice)}")


def normalised(schema: T.StructType, keys: list[str]) -> T.StructType:
    """Keys are never null, everything else may be."""
    return T.StructType([T.StructField(f.name, _nullable(f.dataType), f.name not in keys) for f in schema.fields])


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def merge_types(a: T.DataType, b: T.DataType, where: str) -> T.DataType:
    """The type that holds both: small integers widen, nested types merge, null yields, the rest must be equal."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge(a, b, f"{where}.")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType, f"{where}.element"), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(merge_types(a.keyType, b.keyType, f"{where}.key"), merge_types(a.valueType, b.valueType, f"{where}.value"), True)
    raise SchemaError(f"{where}: {a.simpleString()} and {b.simpleString()} do not merge")


def merge(a: T.StructType, b: T.StructType, where: str = "") -> T.StructType:
    """``a`` with the columns that only ``b`` has at its end."""
    check_names(b)
    out = []
    for f in a.fields:
        other = find(b, f.name)
        out.append(T.StructField(f.name, merge_types(f.dataType, other.dataType, where + f.name) if other else f.dataType, f.nullable))
    return T.StructType(out + [T.StructField(f.name, f.dataType, True) for f in b.fields if not find(a, f.name)])


def check_change(old: T.DataType, new: T.DataType, where: str) -> None:
    """A column may get a type that it can be cast to, without losing nested columns."""
    if isinstance(old, T.StructType) != isinstance(new, T.StructType):
        raise SchemaError(f"{where}: a struct cannot be replaced")
    if isinstance(old, T.StructType):
        for f in old.fields:
            if (other := find(new, f.name)) is None:
                raise SchemaError(f"{where}.{f.name}: nested columns cannot be dropped")
            check_change(f.dataType, other.dataType, f"{where}.{f.name}")
        return
    if isinstance(old, (T.ArrayType, T.MapType)) and old != new:
        raise SchemaError(f"{where}: arrays and maps cannot be replaced")
    numeric = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    widens = type(old) in numeric and type(new) in numeric and numeric.index(type(old)) <= numeric.index(type(new))
    if old != new and not widens and not isinstance(new, T.StringType) and not (isinstance(old, T.DateType) and isinstance(new, T.TimestampType)):
        raise SchemaError(f"{where}: {old.simpleString()} cannot become {new.simpleString()}")


def aligned(df: DataFrame, schema: T.StructType, only_present: bool = False) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones null, or left out if ``only_present``."""
    out: list[Column] = []
    for f in schema.fields:
        own = find(df.schema, f.name)
        if own is None and only_present:
            continue
        out.append((F.lit(None) if own is None else fitted(F.col(f"`{own.name}`"), own.dataType, f.dataType)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def fitted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """Nested structs by name, missing fields null; everything else by cast."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType) and have != want:
        parts = [(fitted(column[o.name], o.dataType, f.dataType) if (o := find(have, f.name)) else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and have != want:
        return F.transform(column, lambda x: fitted(x, have.elementType, want.elementType).cast(want.elementType))
    return column


def by_position(df: DataFrame, schema: T.StructType) -> DataFrame:
    """INSERT by ordinal: casts and names from ``schema``; extra columns at the end keep their names."""
    if len(df.columns) < len(schema.fields):
        raise SchemaError(f"{len(df.columns)} columns for {len(schema.fields)}")
    named = df.toDF(*[f.name for f in schema.fields], *df.columns[len(schema.fields) :])
    return named.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields], *[F.col(f"`{c}`") for c in named.columns[len(schema.fields) :]])
