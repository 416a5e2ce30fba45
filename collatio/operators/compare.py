"""Comparison of the rows of two tables, partition by partition.

Within a partition rows stand in clustering order and are compared in step: from the first place where the clusterings of
both sides differ nothing more is compared, and the partition is a mismatch. As the clusterings of a side are sorted
and unique, that place is the least clustering that one side alone has; so the comparison is relational:

1. both sides are matched by (partition key, clustering): which sides have the row, how many values agree;
2. the least one-sided clustering of each partition bounds what counts;
3. rows that both sides have under that bound are summed by partition.

Three plans give the same result. ``spread`` (the default) deals rows by key and clustering, so that a partition of any
size is spread over tasks; only the slim rows of step 1 meet their partition's bound, in a join that adaptive execution
splits where a partition is hot. ``colocated`` deals rows by partition key once and does all steps there: fewer exchanges,
for tables whose partitions are known to be small. ``positional`` numbers the rows of each side: for keys that are not
unique and for clustering orders that cannot be turned into one rising order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.equality import canonical, same
from ..functions.tokens import MURMUR3, Domain, key_text, md5_number, token
from ..spec import ERROR, MATCHED, SKIPPED, MismatchType, Side, SpecificTokens, TableSpec, quoted
from .filters import allowed, sampled

COUNTS = ("matched_rows", "matched_values", "mismatched_values")


def _values(table: DataFrame, spec: TableSpec, strict_float: bool) -> Column:
    """All regular columns in comparable form; names are places, so that no name can clash."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return F.struct(*[canonical(F.col(quoted(c)), kinds[c], c in spec.sets, strict_float).alias(f"v{i}") for i, c in enumerate(spec.regular)])


def _flipped(column: Column, kind: T.DataType) -> Column | None:
    """A column whose rising order is the falling order of the given one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(column)
    if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        return -column
    if isinstance(kind, T.BooleanType):
        return ~column
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(column))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(column))
    if isinstance(kind, T.TimestampNTZType):  # by its fields, as no time zone may come in
        seconds = F.unix_date(column.cast("date")).cast("bigint") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
        return F.bitwise_not(seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint"))
    return None


def _order_key(table: DataFrame, spec: TableSpec) -> tuple[Column | None, bool]:
    """One rising sort key for the clustering columns, and whether it has to be read backwards; None if there is none.

    Nulls come first in a rising order, and so they come last where all columns fall.
    """
    if not spec.clustering:
        return F.lit(0), False
    columns = [F.col(quoted(c)) for c in spec.clustering]
    if not spec.descending:
        return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), False
    if spec.descending == set(spec.clustering):
        return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), True
    kinds = {f.name: f.dataType for f in table.schema.fields}
    parts = []
    for i, (c, column) in enumerate(zip(spec.clustering, columns, strict=True)):
        turned = _flipped(column, kinds[c]) if c in spec.descending else column
        if turned is None:
            return None, False
        if c in spec.descending:
            parts.append(column.isNull().alias(f"n{i}"))
        parts.append(turned.alias(f"c{i}"))
    return F.struct(*parts), False


def _joined(source: DataFrame, target: DataFrame, spec: TableSpec, strict_float: bool) -> tuple[DataFrame, bool]:
    """The same as ``_rows`` by a full outer join: each side is dealt and sorted by (key, clustering) once."""
    sides, backwards = [], False
    keys = [f"p{i}" for i in range(len(spec.partition_key))]
    for side, table in (("s", source), ("t", target)):
        order, backwards = _order_key(table, spec)
        own = [F.col(quoted(c)).alias(f"{side}_{k}") for k, c in zip(keys, spec.partition_key, strict=True)]
        sides.append(table.select(F.lit(True).alias(f"in_{side}"), *own, order.alias(f"{side}_ck"), _values(table, spec, strict_float).alias(f"{side}_v")))
    on = reduce(lambda x, y: x & y, [F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys])
    if spec.clustering:
        on = on & (F.col("s_ck") == F.col("t_ck"))  # never null itself; nulls inside are equal
    both = sides[0].join(sides[1], on, "full")
    here = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("in_s", "in_t")}
    equal = reduce(lambda x, y: x + y, [same(F.col(f"s_v.v{i}"), F.col(f"t_v.v{i}")) for i in range(len(spec.regular))])
    pick = lambda c: F.when(F.col("in_s").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c)
    return both.select(*[pick(k) for k in keys], pick("ck"), *[c.alias(n) for n, c in here.items()], F.when(here["in_s"] & here["in_t"], equal).alias("equal")), backwards


def _tagged(source: DataFrame, target: DataFrame, spec: TableSpec, strict_float: bool) -> tuple[DataFrame, bool]:
    """Both sides as (side, p0.., ck, v)."""
    sides, backwards = [], False
    for side, table in ((0, source), (1, target)):
        order, backwards = _order_key(table, spec)
        keys = [F.col(quoted(c)).alias(f"p{i}") for i, c in enumerate(spec.partition_key)]
        sides.append(table.select(F.lit(side).alias("side"), *keys, order.alias("ck"), _values(table, spec, strict_float).alias("v")))
    return sides[0].unionByName(sides[1]), backwards


def _rows(tagged: DataFrame, keys: Sequence[str], spec: TableSpec) -> DataFrame:
    """One row for each (key, clustering): in_s, in_t, equal (number of equal values)."""
    a, b = (F.first(F.when(F.col("side") == s, F.col("v")), ignorenulls=True).alias(n) for s, n in ((0, "a"), (1, "b")))
    grouped = tagged.groupBy(*keys, "ck").agg(F.max(F.col("side") == 0).alias("in_s"), F.max(F.col("side") == 1).alias("in_t"), a, b)
    equal = reduce(lambda x, y: x + y, [same(F.col(f"a.v{i}"), F.col(f"b.v{i}")) for i in range(len(spec.regular))])
    return grouped.select(*keys, "ck", "in_s", "in_t", F.when(F.col("in_s") & F.col("in_t"), equal).alias("equal"))


def _reversed(keys: Sequence[str], probability: float, seed: str) -> Column:
    """Whether a partition is read backwards: by the hash of its key, so that it is the same in every run."""
    if probability <= 0:
        return F.lit(False)
    if probability >= 1:
        return F.lit(True)
    return F.pmod(md5_number(F.concat(F.lit(f"{seed}/reverse:"), key_text([F.col(k) for k in keys]))), F.lit(1_000_000)) < int(probability * 1_000_000)


def _summed(rows: DataFrame, keys: Sequence[str], spec: TableSpec, counted: Column, bad: Column) -> DataFrame:
    n = len(spec.regular)
    out = rows.groupBy(*keys).agg(
        F.max("in_s").alias("has_s"), F.max("in_t").alias("has_t"), F.max(bad).alias("stopped"),
        F.count_if(counted).alias("matched_rows"), F.coalesce(F.sum(F.when(counted, F.col("equal"))), F.lit(0)).cast("bigint").alias("matched_values"),
    )
    both = F.col("has_s") & F.col("has_t")
    count = lambda c: F.when(both, c).otherwise(F.lit(0)).cast("bigint")
    return out.select(
        *keys, "has_s", "has_t", (both & ~F.col("stopped")).alias("clusterings_match"), count(F.col("matched_rows")).alias("matched_rows"),
        count(F.col("matched_values")).alias("matched_values"), count(F.col("matched_rows") * n - F.col("matched_values")).alias("mismatched_values"),
    )


def _spread(rows: DataFrame, keys: Sequence[str], spec: TableSpec, backwards: Column) -> DataFrame:
    both = F.col("in_s") & F.col("in_t")
    if not spec.clustering:  # one row for each key: nothing can stop a comparison halfway
        return _summed(rows, keys, spec, both, F.lit(False))
    bounds = rows.where(~both).groupBy(*keys).agg(F.min("ck").alias("least"), F.max("ck").alias("most")).select(*[F.col(k).alias(f"b_{k}") for k in keys], "least", "most")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    bounded = rows.join(bounds, on, "left")
    under = F.when(backwards, F.col("ck") > F.col("most")).otherwise(F.col("ck") < F.col("least"))
    return _summed(bounded, keys, spec, both & (F.col("least").isNull() | under), F.col("least").isNotNull())


def _colocated(tagged: DataFrame, keys: Sequence[str], spec: TableSpec, backwards: Column) -> DataFrame:
    rows = _rows(tagged.repartition(*keys), keys, spec)
    both, own = F.col("in_s") & F.col("in_t"), Window.partitionBy(*keys)
    bounded = rows.withColumns({"least": F.min(F.when(~both, F.col("ck"))).over(own), "most": F.max(F.when(~both, F.col("ck"))).over(own)})
    under = F.when(backwards, F.col("ck") > F.col("most")).otherwise(F.col("ck") < F.col("least"))
    return _summed(bounded, keys, spec, both & (F.col("least").isNull() | under), F.col("least").isNotNull())


def _positional(source: DataFrame, target: DataFrame, spec: TableSpec, probability: float, seed: str, strict_float: bool) -> DataFrame:
    keys = [f"p{i}" for i in range(len(spec.partition_key))]
    numbered = []
    for side, table in ((0, source), (1, target)):
        cluster = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(spec.clustering)]) if spec.clustering else F.lit(0)
        rows = table.select(F.lit(side).alias("side"), *[F.col(quoted(c)).alias(k) for k, c in zip(keys, spec.partition_key, strict=True)], cluster.alias("ck"), _values(table, spec, strict_float).alias("v"))
        backwards = _reversed(keys, probability, seed) if spec.clustering else F.lit(False)
        order = []
        for i, c in enumerate(spec.clustering):
            column, falls = F.col(f"ck.c{i}"), c in spec.descending
            forth, back = (column.desc(), column.asc()) if falls else (column.asc(), column.desc())
            order.append((forth, back))
        ties = F.to_json("v")  # equal keys are compared in a fixed order of their values
        place = lambda columns: F.row_number().over(Window.partitionBy(*keys).orderBy(*columns, ties))  # noqa: E731, B023
        forth = place([f for f, _ in order])
        number = forth if probability <= 0 or not order else F.when(backwards, place([b for _, b in order])).otherwise(forth)
        numbered.append(rows.withColumn("place", number))
    a, b = ((F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)).alias(f"{c}{s}") for s in (0, 1) for c in ("v",))
    c0, c1 = (F.first(F.when(F.col("side") == s, F.struct("ck")), ignorenulls=True).alias(f"k{s}") for s in (0, 1))
    grouped = numbered[0].unionByName(numbered[1]).groupBy(*keys, "place").agg(F.max(F.col("side") == 0).alias("in_s"), F.max(F.col("side") == 1).alias("in_t"), a, b, c0, c1)
    equal = reduce(lambda x, y: x + y, [same(F.col(f"v0.v{i}"), F.col(f"v1.v{i}")) for i in range(len(spec.regular))])
    fits = F.col("in_s") & F.col("in_t") & F.col("k0").eqNullSafe(F.col("k1"))
    rows = grouped.select(*keys, "place", "in_s", "in_t", F.when(fits, equal).alias("equal"), fits.alias("fits"))
    stops = rows.where("not fits").groupBy(*keys).agg(F.min("place").alias("stop")).select(*[F.col(k).alias(f"b_{k}") for k in keys], "stop")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    bounded = rows.join(stops, on, "left")
    return _summed(bounded, keys, spec, F.col("fits") & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))), F.col("stop").isNotNull())


def repeated_keys(table: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys (partition key and clustering) that more than one row has; such tables need the positional plan."""
    columns = [F.col(quoted(c)) for c in (*spec.partition_key, *spec.clustering)]
    return table.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


#: Column of a side that says which rows could not be read; see ``readable``.
UNREADABLE = "__unreadable"


def readable(table: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The table with columns read as the given types, and a flag on rows whose text is not of its type.

    One bad value is an error of its partition alone, not of the whole comparison."""
    bad = [F.col(quoted(c)).isNotNull() & F.col(quoted(c)).try_cast(kind).isNull() for c, kind in kinds.items()]
    columns = [F.col(quoted(c)).try_cast(kinds[c]).alias(c) if c in kinds else F.col(quoted(c)) for c in table.columns]
    return table.select(*columns, reduce(lambda x, y: x | y, bad, F.lit(False)).alias(UNREADABLE))


def broken_partitions(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """(p0.., error_source) of every partition with a row that could not be read; SOURCE where both sides have one."""
    sides = [
        t.where(F.col(UNREADABLE)).select(*[F.col(quoted(c)).alias(f"p{i}") for i, c in enumerate(spec.partition_key)], F.lit(side.value).alias("error_source"))
        for t, side in ((source, Side.SOURCE), (target, Side.TARGET)) if UNREADABLE in t.columns
    ]
    return reduce(DataFrame.unionByName, sides).groupBy(*[f"p{i}" for i in range(len(spec.partition_key))]).agg(F.min("error_source").alias("error_source"))


def partition_stats(
    source: DataFrame, target: DataFrame, spec: TableSpec, *, plan: str = "spread", domain: Domain = MURMUR3, tokens: SpecificTokens | None = None,
    sampling: float = 1.0, reverse_probability: float = 0.0, job_id: str = "", strict_float: bool = False,
) -> DataFrame:
    """One row for each partition of either side: partition key, token, status, clusterings_match, matched_rows,
    matched_values, mismatched_values.

    status is ONLY_IN_SOURCE, ONLY_IN_TARGET, MATCHED, PARTITION_MISMATCH, SKIPPED (its token is not to be compared) or
    ERROR (a row of it could not be read, see ``readable``; nothing of it is counted).
    Keys on both sides that sampling leaves out have no row; keys on one side are never left out nor skipped.
    """
    for column in (*spec.partition_key, *spec.clustering, *spec.regular):
        if column not in target.columns or column not in source.columns:
            raise ValueError(f"column {column} is missing on one side")
    keys = [f"p{i}" for i in range(len(spec.partition_key))]
    if plan == "positional" or _order_key(source, spec)[0] is None:
        summed = _positional(source, target, spec, reverse_probability, job_id, strict_float)
    else:
        how, deal = {"spread": (_spread, _joined), "colocated": (_colocated, _tagged)}[plan]
        dealt, falling = deal(source, target, spec, strict_float)
        back = _reversed(keys, reverse_probability, job_id) if spec.clustering else F.lit(False)
        summed = how(dealt, keys, spec, ~back if falling else back)
    both = F.col("has_s") & F.col("has_t")
    found = summed.withColumn("token", token([F.col(k) for k in keys], domain))
    found = found.where(~both | sampled([F.col(k) for k in keys], sampling, job_id))
    skip, failed = both & ~allowed(F.col("token"), tokens), F.lit(False)
    if UNREADABLE in source.columns or UNREADABLE in target.columns:
        bad = broken_partitions(source, target, spec).select(*[F.col(k).alias(f"e_{k}") for k in keys], "error_source")
        found = found.join(bad, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys]), "left")
        failed = both & ~skip & F.col("error_source").isNotNull()
    status = (
        F.when(~F.col("has_t"), MismatchType.ONLY_IN_SOURCE.value).when(~F.col("has_s"), MismatchType.ONLY_IN_TARGET.value).when(skip, SKIPPED).when(failed, ERROR)
        .when(F.col("clusterings_match") & (F.col("mismatched_values") == 0), MATCHED).otherwise(MismatchType.PARTITION_MISMATCH.value)
    )
    count = lambda c: F.when(skip | failed, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, spec.partition_key, strict=True)], "token", status.alias("status"), "clusterings_match", *[count(c) for c in COUNTS])


def mismatches(stats: DataFrame) -> DataFrame:
    """(token, mismatch_type) of every partition that differs."""
    return stats.where(~F.col("status").isin(MATCHED, SKIPPED, ERROR)).select("token", F.col("status").alias("mismatch_type"))
