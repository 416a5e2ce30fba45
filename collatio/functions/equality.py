"""Null-safe equality of values of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Column, kind: T.DataType, as_set: bool = False, strict_float: bool = False) -> Column:
    """A value in a form on which ``<=>`` is the wanted equality.

    Maps become sorted entries and sets sorted arrays, at any depth; variants become JSON. With ``strict_float`` the two
    zeros differ (NaN always equals NaN).
    """
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(canonical(e["key"], kind.keyType, False, strict_float).alias("k"), canonical(e["value"], kind.valueType, False, strict_float).alias("v")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        inner = _plain(kind.elementType, strict_float)
        out = value if inner else F.transform(value, lambda e: canonical(e, kind.elementType, False, strict_float))
        return F.array_sort(out) if as_set else out
    if isinstance(kind, T.StructType) and not _plain(kind, strict_float):
        fields = F.struct(*[canonical(value[f.name], f.dataType, False, strict_float).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, (T.FloatType, T.DoubleType)) and strict_float:
        return F.when(value.isNotNull(), F.struct(value.alias("x"), value.cast("string").alias("t")))
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value


def _plain(kind: T.DataType, strict_float: bool) -> bool:
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType, strict_float)
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType, strict_float) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType)) and not (strict_float and isinstance(kind, (T.FloatType, T.DoubleType)))


def same(a: Column, b: Column) -> Column:
    """1 if both are null or equal, else 0."""
    return a.eqNullSafe(b).cast("int")
