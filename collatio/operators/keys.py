"""Key scans, point reads and the key join of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import MURMUR3, Domain, token
from ..spec import TableSpec, quoted


def key_columns(spec: TableSpec) -> list[Column]:
    return [F.col(quoted(c)) for c in spec.partition_key]


def key_scan(table: DataFrame, spec: TableSpec, low: int | None = None, high: int | None = None, domain: Domain = MURMUR3, low_inside: bool = False) -> DataFrame:
    """Distinct (token, partition key) with low < token <= high; ``low_inside`` takes the first token as well."""
    out = table.select(token(key_columns(spec), domain).alias("token"), *key_columns(spec))
    if low is not None:
        out = out.where(F.col("token") >= low if low_inside else F.col("token") > low)
    if high is not None:
        out = out.where(F.col("token") <= high)
    return out.distinct()


def partition_read(table: DataFrame, spec: TableSpec, key: tuple, reverse: bool = False, domain: Domain = MURMUR3) -> DataFrame:
    """Rows of one partition with their token, in clustering order or with every clustering order turned round."""
    if len(key) != len(spec.partition_key):
        raise ValueError("a value for every column of the partition key is needed")
    out = table.select(token(key_columns(spec), domain).alias("token"), *table.columns)
    for column, value in zip(key_columns(spec), key, strict=True):
        out = out.where(column.eqNullSafe(F.lit(value)))
    order = [F.col(quoted(c)).desc() if (c in spec.descending) != reverse else F.col(quoted(c)).asc() for c in spec.clustering]
    return out.orderBy(*order) if order else out


def key_join(source: DataFrame, target: DataFrame, spec: TableSpec, domain: Domain = MURMUR3) -> DataFrame:
    """(token, partition key, in_source, in_target) of every key on either side, with one exchange."""
    tagged = source.select(F.lit(0).alias("__side"), *key_columns(spec)).unionByName(target.select(F.lit(1).alias("__side"), *key_columns(spec)))
    grouped = tagged.groupBy(*key_columns(spec)).agg(F.max(F.col("__side") == 0).alias("in_source"), F.max(F.col("__side") == 1).alias("in_target"))
    return grouped.select(token(key_columns(spec), domain).alias("token"), *key_columns(spec), "in_source", "in_target")


def only_in_source(source: DataFrame, target: DataFrame, spec: TableSpec, domain: Domain = MURMUR3) -> DataFrame:
    return key_join(source, target, spec, domain).where("in_source and not in_target").drop("in_source", "in_target")


def only_in_target(source: DataFrame, target: DataFrame, spec: TableSpec, domain: Domain = MURMUR3) -> DataFrame:
    return key_join(source, target, spec, domain).where("in_target and not in_source").drop("in_source", "in_target")


def in_both(source: DataFrame, target: DataFrame, spec: TableSpec, domain: Domain = MURMUR3) -> DataFrame:
    return key_join(source, target, spec, domain).where("in_source and in_target").drop("in_source", "in_target")
