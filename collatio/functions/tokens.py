"""Tokens of partition keys and the domains that they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """Smallest and largest token, both inside."""

    name: str
    low: int
    high: int


MURMUR3 = Domain("Murmur3Partitioner", -(2**63), 2**63 - 1)
RANDOM = Domain("RandomPartitioner", -1, 2**127 - 1)
#: 60 bits of the MD5 of the key as text: other engines can compute it too.
PORTABLE = Domain("PortablePartitioner", 0, 2**60 - 1)


def domain_of(partitioner: str) -> Domain:
    """By the end of a partitioner's class name."""
    for d in (MURMUR3, RANDOM, PORTABLE):
        if partitioner.endswith(d.name):
            return d
    raise ValueError(f"unsupported partitioner: {partitioner}")


def key_text(keys: list[Column]) -> Column:
    """Key components as one text; no two keys share it, as lengths go before the parts of a compound key."""
    texts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def md5_number(text: Column) -> Column:
    """The first 60 bits of an MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def token(keys: list[Column], domain: Domain = MURMUR3) -> Column:
    """A key's token: 64-bit xxhash in the Murmur3 domain, the MD5 prefix in the portable one."""
    if domain is MURMUR3:
        return F.xxhash64(*keys)
    if domain is PORTABLE:
        return md5_number(key_text(keys))
    raise ValueError(f"no token function for {domain.name}")
