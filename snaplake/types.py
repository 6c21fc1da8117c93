"""Schema union: the widening lattice, alignment and null-filling union of frames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def nullable(t: T.DataType) -> T.DataType:
    """The type with nulls allowed in all of its parts."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(nullable(t.keyType), nullable(t.valueType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in t.fields])
    return t


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: strings win, then times, dates, floats, integers; anything else becomes a string."""
    if a.simpleString() == b.simpleString():
        return nullable(a)
    pair = (a, b)

    def has(*kinds: type) -> bool:
        return any(isinstance(t, kinds) for t in pair)

    def only(*kinds: type) -> bool:
        return all(isinstance(t, kinds) for t in pair)

    if only(*_INTS):
        return T.LongType()
    if only(*_INTS, *_FLOATS):
        return T.DoubleType()
    if only(T.DecimalType):
        whole = max(a.precision - a.scale, b.precision - b.scale)
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, whole + scale), scale)
    if only(T.DecimalType, *_INTS, *_FLOATS):
        return T.DoubleType()
    if only(T.TimestampType, T.TimestampNTZType, T.DateType):
        return T.TimestampNTZType() if has(T.TimestampType, T.TimestampNTZType) else T.DateType()
    if only(T.NullType, T.DataType) and has(T.NullType):
        return b if isinstance(a, T.NullType) else a
    return T.StringType()


def union_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """All columns in order of first appearance, each with the widest type; names compare without case."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            old = found.get(f.name.lower())
            found[f.name.lower()] = T.StructField(old.name, widen(old.dataType, f.dataType), True) if old else T.StructField(f.name, nullable(f.dataType), True)
    return T.StructType(list(found.values()))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns in order; values that can't be cast and missing columns are null."""
    have = {f.name.lower(): f for f in df.schema.fields}

    def column(f: T.StructField):
        old = have.get(f.name.lower())
        if old is None:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{old.name}`")
        return (c if old.dataType.simpleString() == f.dataType.simpleString() else c.try_cast(f.dataType)).alias(f.name)

    return df.select(*map(column, schema.fields))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under their union schema."""
    schema = union_schema(f.schema for f in frames)
    return reduce(DataFrame.unionByName, [align(f, schema) for f in frames])
