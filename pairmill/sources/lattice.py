"""Union of configs whose schemas contradict one another, field by field.

Two types meet in the least type that holds both: numbers widen (to DOUBLE where no exact type does, so whole
numbers beyond 2 ** 53 are rounded there), a date becomes a timestamp, structs are
merged by field name and arrays by element. What has no common type, as text against an object, is packed
as VARIANT, which keeps each value as it was. Types are compared once, on the driver; rows only see casts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _whole_digits(kind: T.DataType) -> int | None:
    return {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}.get(type(kind))


def least_common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds values of both, VARIANT if there is no other."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(least_common(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, least_common(a.valueType, b.valueType))
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max((a, b), key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_whole_digits(t), 0) for t in (a, b)]
        whole, scale = max(s[0] for s in sizes), max(s[1] for s in sizes)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.VariantType()


def merged(schemas: Sequence[T.StructType]) -> T.StructType:
    """All fields in the order in which they first appear; each may be NULL."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            kinds[field.name] = least_common(kinds[field.name], field.dataType) if field.name in kinds else field.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _plain(kind: T.DataType) -> T.DataType:
    """The type without NOT NULL, as the union has it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _plain(kind.valueType))
    return kind


def converted(value: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """``value`` of type ``kind`` as ``wanted``, a type that ``least_common`` made of it."""
    if kind == wanted:
        return value
    if isinstance(kind, T.NullType):
        return F.lit(None).cast(wanted)
    if isinstance(wanted, T.VariantType):
        return F.to_variant_object(value) if isinstance(kind, _NESTED) else value.cast(wanted)
    if isinstance(kind, T.StructType):
        own = {f.name: f.dataType for f in kind}
        fields = [
            (converted(value.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: converted(x, kind.elementType, wanted.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: converted(x, kind.valueType, wanted.valueType))
    return value.cast(wanted)


def union_conflicting(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts under one schema; missing fields are NULL, conflicting ones widened or VARIANT."""
    schemas = [_plain(part.schema) for part in parts]
    wanted = merged(schemas)

    def fitted(part: DataFrame, schema: T.StructType) -> DataFrame:
        own = {f.name: f.dataType for f in schema}
        return part.select(*[
            (converted(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted
        ])

    return reduce(DataFrame.union, [fitted(p, s) for p, s in zip(parts, schemas)])
