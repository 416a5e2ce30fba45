"""Splits of the token domain."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import MURMUR3, Domain
from ..spec import Modifier, SpecificTokens


@dataclass(frozen=True)
class Split:
    number: int
    bucket: int
    start: int
    end: int

    def contains_any(self, tokens: Iterable[int]) -> bool:
        return any(self.start <= t <= self.end for t in tokens)


def segment(n: int, domain: Domain) -> int:
    return (domain.high - domain.low) // n


def calculate_splits(n: int, buckets: int, domain: Domain = MURMUR3) -> list[Split]:
    """n splits that cover the domain, both ends inside: the first has one token more, the last takes what is left.

    One split is the whole domain.
    """
    if n < 1 or buckets < 1:
        raise ValueError("at least one split and one bucket")
    size = segment(n, domain)
    ends = [domain.low + size * (i + 1) for i in range(n - 1)] + [domain.high]
    starts = [domain.low] + [e + 1 for e in ends[:-1]]
    return [Split(i, i % buckets, s, e) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def splits_frame(spark: SparkSession, n: int, buckets: int, domain: Domain = MURMUR3) -> DataFrame:
    """(split, bucket, start_token, end_token) of a domain of 64 bits, without a driver-side list."""
    if domain.high >= 2**63:
        raise ValueError(f"tokens of {domain.name} are wider than 64 bits; use calculate_splits")
    size, low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in (segment(n, domain), domain.low, domain.high))
    i = F.col("id").cast("decimal(19,0)")
    start = F.when(F.col("id") == 0, low).otherwise(low + size * i + F.lit(1))
    end = F.when(F.col("id") == n - 1, high).otherwise(low + size * (i + F.lit(1)))
    return spark.range(n).select(F.col("id").cast("int").alias("split"), F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"), start.cast("bigint").alias("start_token"), end.cast("bigint").alias("end_token"))


def split_of(token: Column, n: int, domain: Domain = MURMUR3) -> Column:
    """The split that holds a token."""
    size = segment(n, domain)
    if n == 1 or size == 0:
        return F.lit(0)
    number = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    over = token.cast("decimal(38,0)") - number(domain.low + 1)  # a whole division truncates, so the first token gets 0
    return F.least(F.call_function("div", over, number(size)).cast("int"), F.lit(n - 1))


def filter_splits(splits: list[Split], tokens: SpecificTokens) -> list[Split]:
    """Only splits with a token to accept; tokens to reject drop no split."""
    if not tokens.tokens or tokens.modifier is Modifier.REJECT:
        return splits
    return [s for s in splits if s.contains_any(tokens.tokens)]


def check_range(start: int | None, end: int | None, domain: Domain) -> None:
    if start is None or end is None or not domain.low <= start < end <= domain.high:
        raise ValueError(f"not a range of {domain.name}: {start} to {end}")
