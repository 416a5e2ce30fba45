"""Connected components of a graph given as pairs, without gathering links anywhere.

Large-star and small-star steps alternate until the pairs stop changing. A hub's pairs stay spread: the smallest
neighbour is found by partial aggregation and joined back, which adaptive execution splits where one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _links(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[int, int]]:
    """The pairs, stored, and a mark of them, seen while they are written."""
    seen = Observation()
    now = scratch.stored(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "links", release=False)
    return now, (seen.get["n"], seen.get["x"] or 0)


def connected_components(pairs: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``pairs`` (columns u, v); component is the smallest node of it.

    Null ends and self-links are ignored; repeated pairs count once; no pairs give no rows.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "components")
    now, mark = _links(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scratch)
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        before = mark
        now, mark = _links(small, scratch)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
