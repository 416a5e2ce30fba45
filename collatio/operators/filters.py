"""Filters: token lists, sampling, splits that are done, where a split goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import key_text, md5_number
from ..spec import Modifier, SpecificTokens


def allowed(token: Column, tokens: SpecificTokens | None) -> Column:
    """Whether a token is to be compared; an empty list lets all pass. The list is part of the configuration, so it is small."""
    if tokens is None or not tokens.tokens:
        return F.lit(True)
    listed = token.isin(sorted(tokens.tokens))
    return listed if tokens.modifier is Modifier.ACCEPT else ~listed


def check_probability(p: float) -> None:
    if not 0 < p <= 1:
        raise ValueError(f"a sampling probability must be in (0, 1]: {p}")


def sampled(keys: list[Column], probability: float, job_id: str) -> Column:
    """A sample by the hash of job and key: the same keys in every run of a job, whatever the splits."""
    check_probability(probability)
    if probability == 1:
        return F.lit(True)
    return F.pmod(md5_number(F.concat(F.lit(f"{job_id}:"), key_text(keys))), F.lit(1_000_000)) < int(probability * 1_000_000)


def open_splits(splits: DataFrame, status: DataFrame, include_completed: bool = False) -> DataFrame:
    """Splits (split, bucket, start_token, end_token) joined with their latest status (split, last_token and counters):
    those already read to their end are left out unless ``include_completed``; counters not there are 0.

    ``resume_after`` is the last token read, null where the split begins anew.
    """
    counters = [c for c in status.columns if c not in ("split", "last_token")]
    joined = splits.join(status, "split", "left")
    done = F.col("last_token").eqNullSafe(F.col("end_token"))
    out = joined if include_completed else joined.where(~done)
    resume = F.lit(None).cast("bigint") if include_completed else F.col("last_token")
    return out.select(*splits.columns, resume.alias("resume_after"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters])
