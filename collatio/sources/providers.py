"""Where the two sides come from: providers named in the configuration and loaded by name."""

from __future__ import annotations

import os
from importlib import import_module
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators.schema import Schema, discover
from ..spec import TableName, quoted


class SideError(RuntimeError):
    """An error that one side caused."""

    def __init__(self, side: str, cause: BaseException):
        super().__init__(f"{side}: {cause}")
        self.side, self.__cause__ = side, cause


def side_of(error: BaseException | None, depth: int = 10) -> str:
    """The side that an error came from, looked for along its causes; blank if none says so."""
    while error is not None and depth:
        if isinstance(error, SideError):
            return error.side
        error, depth = error.__cause__ or error.__context__, depth - 1
    return ""


class Provider(Protocol):
    """A side of the comparison."""

    partitioner: str

    def initialize(self, options: dict[str, Any], name: str) -> None: ...

    def table(self, spark: SparkSession, name: TableName) -> DataFrame: ...

    def schema(self, spark: SparkSession, disallowed) -> Schema: ...

    def description(self) -> str: ...


class FormatProvider:
    """Any Spark source: ``format``, ``options`` and ``path``, in which {keyspace} and {table} are put.

    Without a path the tables of the catalog are read. User and password come from the environment
    (``COLLATIO_<NAME>_USER`` and ``COLLATIO_<NAME>_PASSWORD``) and become the options of those names. With ``dc`` only
    the description changes.
    """

    def initialize(self, options: dict[str, Any], name: str) -> None:
        self.name = options.get("name", name)
        self.format, self.path = options.get("format", "parquet"), options.get("path")
        self.options, self.tables = dict(options.get("options") or {}), options.get("tables") or []
        self.partitioner, self.dc = options.get("partitioner", "Murmur3Partitioner"), options.get("dc")
        for key in ("user", "password"):
            if value := os.environ.get(f"COLLATIO_{name.upper()}_{key.upper()}"):
                self.options[key] = value

    def table(self, spark: SparkSession, name: TableName) -> DataFrame:
        if self.path is None:
            return spark.table(f"{quoted(name.keyspace)}.{quoted(name.table)}")
        options = {k: str(v).format(keyspace=name.keyspace, table=name.table) for k, v in self.options.items()}
        return spark.read.format(self.format).options(**options).load(self.path.format(keyspace=name.keyspace, table=name.table))

    def schema(self, spark: SparkSession, disallowed) -> Schema:
        if self.path is None:
            return discover(spark, disallowed)
        return Schema(t for t in map(TableName.parse, self.tables) if t.keyspace not in set(disallowed))

    def description(self) -> str:
        return f"{self.name} ({self.format}{', ' + self.dc if self.dc else ''})"


def load_provider(options: dict[str, Any], name: str) -> Provider:
    """``impl`` names a class as module.Class; without it Spark's own sources are read."""
    impl = options.get("impl")
    if impl is None:
        provider: Provider = FormatProvider()
    else:
        module, _, cls = impl.rpartition(".")
        provider = getattr(import_module(module), cls)()
    provider.initialize(options, name)
    return provider
