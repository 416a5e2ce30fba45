"""Statistics of ranges, tables and jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.tokens import MURMUR3, Domain
from ..spec import ERROR, MATCHED, SKIPPED, MismatchType
from .splits import split_of

COUNTERS = (
    "matched_partitions", "mismatched_partitions", "error_partitions", "skipped_partitions", "only_in_source",
    "only_in_target", "matched_rows", "matched_values", "mismatched_values",
)


@dataclass
class RangeStats:
    """The nine counters; adding is associative and commutative."""

    matched_partitions: int = 0
    mismatched_partitions: int = 0
    error_partitions: int = 0
    skipped_partitions: int = 0
    only_in_source: int = 0
    only_in_target: int = 0
    matched_rows: int = 0
    matched_values: int = 0
    mismatched_values: int = 0

    def __add__(self, other: RangeStats) -> RangeStats:
        return RangeStats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    @property
    def all_matches(self) -> bool:
        """Nothing found on one side alone, no error, no differing value, nothing skipped. A partition that differs in its
        clusterings alone does not show here; ``mismatched_partitions`` counts it."""
        return not (self.only_in_source or self.only_in_target or self.error_partitions or self.mismatched_values or self.skipped_partitions)

    @property
    def is_empty(self) -> bool:
        return self == RangeStats()

    def __str__(self) -> str:
        return SUMMARY % tuple(getattr(self, c) for c in SUMMARY_ORDER)

    @staticmethod
    def of(row: Row | dict | None) -> RangeStats:
        if row is None:
            return RangeStats()
        values = row.asDict() if isinstance(row, Row) else row
        return RangeStats(**{c: int(values.get(c) or 0) for c in COUNTERS})


SUMMARY_ORDER = COUNTERS
SUMMARY = (
    "Matched Partitions - %d, Mismatched Partitions - %d, Partition Errors - %d, Partitions Skipped - %d, Partitions Only In Source - %d, "
    "Partitions Only In Target - %d, Matched Rows - %d, Matched Values - %d, Mismatched Values - %d"
)


def _counters() -> list[Column]:
    status = F.col("status")
    of = {
        "matched_partitions": MATCHED, "mismatched_partitions": MismatchType.PARTITION_MISMATCH.value, "skipped_partitions": SKIPPED, "error_partitions": ERROR,
        "only_in_source": MismatchType.ONLY_IN_SOURCE.value, "only_in_target": MismatchType.ONLY_IN_TARGET.value,
    }
    return [F.count_if(status == of[c]).alias(c) if c in of else F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]


def aggregate(stats: DataFrame, by: Sequence[str | Column] = (), also: Sequence[Column] = ()) -> DataFrame:
    """The nine counters of partition statistics, over all or by group, and further aggregates."""
    return stats.groupBy(*by).agg(*_counters(), *also)


def by_split(stats: DataFrame, n: int, domain: Domain = MURMUR3) -> DataFrame:
    """Counters and highest token of every split that holds a partition."""
    split = stats.withColumn("split", split_of(F.col("token"), n, domain))
    return aggregate(split, ["split"], [F.max("token").alias("highest_token")])


def accumulate(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of counters that are already summed in part."""
    return stats.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def verdicts(stats: DataFrame) -> DataFrame:
    """Counters with ``all_matches``, ``is_empty`` and the summary text."""
    none = lambda names: F.lit(True) if not names else F.col(names[0]).eqNullSafe(F.lit(0).cast("bigint")) & none(names[1:])
    return stats.withColumns({
        "all_matches": none(["only_in_source", "only_in_target", "error_partitions", "mismatched_values", "skipped_partitions"]),
        "is_empty": none(list(COUNTERS)),
        "summary": F.format_string(SUMMARY, *[F.col(c) for c in SUMMARY_ORDER]),
    })
