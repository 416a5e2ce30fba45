"""What is compared and how: table names, table shapes, token lists and the job's configuration."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

log = logging.getLogger(__name__)


class Side(str, Enum):
    SOURCE = "SOURCE"
    TARGET = "TARGET"


class MismatchType(str, Enum):
    ONLY_IN_SOURCE = "ONLY_IN_SOURCE"
    ONLY_IN_TARGET = "ONLY_IN_TARGET"
    PARTITION_MISMATCH = "PARTITION_MISMATCH"


MATCHED = "MATCHED"
SKIPPED = "SKIPPED"
ERROR = "ERROR"


@dataclass(frozen=True, order=True)
class TableName:
    """``keyspace.table``; the two parts are trimmed and must not be empty."""

    keyspace: str
    table: str

    @staticmethod
    def parse(text: str) -> TableName:
        parts = [p.strip() for p in text.split(".")]
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"not a table name of the form keyspace.table: {text!r}")
        return TableName(*parts)

    def __str__(self) -> str:
        return f"{self.keyspace}.{self.table}"


def quoted(name: str) -> str:
    """An identifier in backticks, unless it is already."""
    return name if len(name) > 1 and name[0] == name[-1] == "`" else "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class TableSpec:
    """Key columns of a table. Partition-key columns count as regular ones, so they are compared as values too.

    ``descending``: clustering columns in falling order; ``sets``: array columns that are compared without order.
    """

    partition_key: tuple[str, ...]
    clustering: tuple[str, ...] = ()
    regular: tuple[str, ...] = ()
    descending: frozenset[str] = frozenset()
    sets: frozenset[str] = frozenset()

    @staticmethod
    def of(columns: list[str], partition_key, clustering=(), descending=(), sets=()) -> TableSpec:
        pk, ck = tuple(partition_key), tuple(clustering)
        missing = [c for c in (*pk, *ck) if c not in columns]
        if not pk or missing:
            raise ValueError(f"key columns are not in the table: {missing or 'no partition key given'}")
        if set(descending) - set(ck):
            raise ValueError("only clustering columns have an order")
        return TableSpec(pk, ck, tuple(c for c in columns if c not in ck), frozenset(descending), frozenset(sets))

    def check_same(self, other: TableSpec) -> None:
        """Column names and their order must agree; types are left to the comparison."""
        if (self.clustering, self.regular) != (other.clustering, other.regular):
            raise ValueError(f"tables differ in columns: {self.clustering + self.regular} and {other.clustering + other.regular}")


class Modifier(str, Enum):
    ACCEPT = "ACCEPT"
    REJECT = "REJECT"


@dataclass(frozen=True)
class SpecificTokens:
    """Tokens to compare alone, or not at all. An empty list lets everything pass."""

    tokens: frozenset[int] = frozenset()
    modifier: Modifier = Modifier.REJECT

    @staticmethod
    def parse(text: str | None, modifier: Modifier) -> SpecificTokens:
        return SpecificTokens(frozenset(int(t) for t in (text or "").split(",") if t.strip()), modifier)

    def allows(self, token: int) -> bool:
        return not self.tokens or (token in self.tokens) == (self.modifier is Modifier.ACCEPT)


NO_TOKENS = SpecificTokens()


@dataclass(frozen=True)
class MetadataOptions:
    keyspace: str = "collatio"
    replication: str = ""
    ttl_seconds: int = 31_536_000
    should_init: bool = False


@dataclass(frozen=True)
class RetryOptions:
    impl: str = "exponential"
    base_delay_ms: int = 1000
    total_delay_ms: int = 1_800_000


@dataclass(frozen=True)
class JobConfig:
    """A job; field names are the keys of the YAML file."""

    splits: int = 10_000
    keyspace_tables: tuple[TableName, ...] | None = None
    disallowed_keyspaces: tuple[str, ...] = ()
    buckets: int = 100
    rate_limit: int = 10_000
    job_id: uuid.UUID | None = None
    token_scan_fetch_size: int = 0
    partition_read_fetch_size: int = 0
    read_timeout_millis: int = 0
    reverse_read_probability: float = 0.0
    consistency_level: str = "ALL"
    metadata_options: MetadataOptions = MetadataOptions()
    cluster_config: dict[str, dict[str, Any]] = field(default_factory=dict)
    specific_tokens: SpecificTokens = NO_TOKENS
    retry_options: RetryOptions | None = None
    partition_sampling_probability: float = 1.0
    table_specs: dict[str, dict[str, Any]] = field(default_factory=dict)
    waves: int = 1

    def __post_init__(self):
        if not 0 < self.partition_sampling_probability <= 1:
            raise ValueError(f"partition_sampling_probability must be in (0, 1]: {self.partition_sampling_probability}")
        if not 0 <= self.reverse_read_probability <= 1:
            raise ValueError(f"reverse_read_probability must be in [0, 1]: {self.reverse_read_probability}")
        if self.splits < 1 or self.buckets < 1 or self.waves < 1:
            raise ValueError("splits, buckets and waves are 1 at least")

    @property
    def auto_discovery(self) -> bool:
        """No list of tables was given; a list whose keyspaces are all disallowed is an empty list, not this."""
        return not self.keyspace_tables

    @property
    def tables(self) -> list[TableName]:
        return [t for t in self.keyspace_tables or () if t.keyspace not in self.disallowed_keyspaces]

    @staticmethod
    def of(raw: dict[str, Any]) -> JobConfig:
        """From the mapping that a YAML file holds; unknown keys are refused."""
        raw = dict(raw)
        accept, reject = raw.pop("specific_tokens", None), raw.pop("disallowed_tokens", None)
        if accept and reject:
            raise ValueError("specific_tokens and disallowed_tokens exclude each other")
        known = {f for f in JobConfig.__dataclass_fields__}
        if unknown := set(raw) - known:
            raise ValueError(f"unknown keys in the configuration: {sorted(unknown)}")
        out: dict[str, Any] = {k: v for k, v in raw.items() if v is not None}
        if out.get("keyspace_tables"):
            out["keyspace_tables"] = tuple(TableName.parse(t) for t in out["keyspace_tables"])
        if "disallowed_keyspaces" in out:
            out["disallowed_keyspaces"] = tuple(out["disallowed_keyspaces"])
        if "job_id" in out:
            out["job_id"] = uuid.UUID(str(out["job_id"]))
        if "metadata_options" in out:
            out["metadata_options"] = MetadataOptions(**out["metadata_options"])
        if "retry_options" in out:
            out["retry_options"] = RetryOptions(**out["retry_options"])
        out["specific_tokens"] = SpecificTokens.parse(str(accept), Modifier.ACCEPT) if accept else SpecificTokens.parse(str(reject), Modifier.REJECT) if reject else NO_TOKENS
        return JobConfig(**out)

    @staticmethod
    def load(path: str) -> JobConfig:
        import yaml

        with open(path) as f:
            return JobConfig.of(yaml.safe_load(f) or {})
