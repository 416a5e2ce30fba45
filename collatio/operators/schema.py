"""Sets of tables: intersection, differences, discovery."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import TableName

log = logging.getLogger(__name__)

# Keyspaces that hold no user data.
SYSTEM_KEYSPACES = frozenset({"system", "system_schema", "system_traces", "system_auth", "system_distributed", "system_virtual_schema", "system_views"})


class Schema:
    """A set of qualified tables."""

    def __init__(self, tables: Iterable[TableName]):
        self.tables = frozenset(tables)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.tables == other.tables

    def __hash__(self) -> int:
        return hash(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def intersect(self, other: Schema) -> Schema:
        return self if self == other else Schema(self.tables & other.tables)

    def difference(self, other: Schema) -> tuple[Schema, Schema]:
        """What only this one has, and what only the other has."""
        return Schema(self.tables - other.tables), Schema(other.tables - self.tables)

    def names(self) -> list[TableName]:
        return sorted(self.tables)


def excluded(disallowed: Iterable[str] = ()) -> frozenset[str]:
    return SYSTEM_KEYSPACES | frozenset(disallowed)


def common_tables(source: Schema, target: Schema) -> list[TableName]:
    """Tables on both sides; what one side lacks is logged."""
    ours, theirs = source.difference(target)
    for side, lone in (("source", ours), ("target", theirs)):
        if len(lone):
            log.warning("tables only in %s are not compared: %s", side, ", ".join(map(str, lone.names())))
    return source.intersect(target).names()


def discover(spark: SparkSession, disallowed: Iterable[str] = ()) -> Schema:
    """All tables of the catalog but those of system and disallowed keyspaces."""
    skip = excluded(disallowed)
    return Schema(TableName(d.name, t.name) for d in spark.catalog.listDatabases() if d.name not in skip for t in spark.catalog.listTables(d.name) if not t.isTemporary)


def allowed_tables(tables: DataFrame, disallowed: Iterable[str] = (), column: str = "qualified_table_name") -> DataFrame:
    """The tables that are in no system or disallowed keyspace."""
    return tables.where(~F.substring_index(column, ".", 1).isin(sorted(excluded(disallowed))))


def intersect_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns..) of what one side alone has."""
    return a.subtract(b).select(F.lit("left").alias("side"), "*").union(b.subtract(a).select(F.lit("right").alias("side"), "*"))
