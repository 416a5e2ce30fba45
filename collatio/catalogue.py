"""Queries of the library on the test tables, and DuckDB SQL for each of them.

The target side of a comparison is a copy of a table changed by SQL that both engines run.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable
from datetime import date
from uuid import UUID

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions.tokens import MURMUR3, PORTABLE, token
from .operators import compare, keys, stats
from .operators.filters import open_splits
from .operators.schema import Schema, allowed_tables, difference_frame, excluded, intersect_frame
from .operators.splits import calculate_splits, check_range, filter_splits, split_of, splits_frame
from .plans.journal import Journal, latest_rows, new_id
from .plans.retry import strategy
from .plans.runner import DiffJob
from .plans.store import remove
from .spec import JobConfig, MetadataOptions, Modifier, RetryOptions, SpecificTokens, TableName, TableSpec

SPLITS, BUCKETS = 50, 7
JOB = "00000000-0000-0000-0000-000000000001"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Two sides of each comparison: SQL for both engines, with the tables in braces.
SIDES = {
    "orders": (
        "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM {orders}",
        """SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
           FROM {orders} WHERE o_custkey % 17 <> 3 AND NOT (o_custkey % 5 = 1 AND o_orderkey % 11 = 0)
           UNION ALL SELECT o_custkey + 1000000000, o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_custkey % 19 = 0""",
    ),
    "customer": (
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {customer}",
        """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
           FROM {customer} WHERE c_custkey % 17 <> 3
           UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {customer} WHERE c_custkey % 19 = 0""",
    ),
    "events": (
        "SELECT user_id, ts, event_id, event_type, value FROM {events}",
        """SELECT user_id, ts, event_id, event_type, CASE WHEN event_id % 101 = 0 THEN value + 1 ELSE value END AS value FROM {events} WHERE user_id % 17 <> 3 AND NOT (user_id % 5 = 1 AND event_id % 37 = 0)
           UNION ALL SELECT user_id + 1000000000, ts, event_id, event_type, value FROM {events} WHERE user_id % 19 = 0""",
    ),
    "nulls": (
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM {customer}",
        "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM {customer}",
    ),
    "vectors": (
        "SELECT vec_id, embedding, label FROM {embeddings}",
        "SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN {reverse}(embedding) WHEN vec_id % 7 = 0 THEN NULL ELSE embedding END AS embedding, label FROM {embeddings}",
    ),
    "part": (
        "SELECT p_partkey, p_name, p_size, p_retailprice FROM {part}",
        "SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM {part} WHERE p_partkey % 23 <> 5",
    ),
}
KEYS = {"orders": (["o_custkey"], ["o_orderkey"]), "customer": (["c_custkey"], []), "events": (["user_id"], ["ts", "event_id"]), "nulls": (["c_custkey"], []), "vectors": (["vec_id"], []), "part": (["p_partkey"], [])}
VALUES = {
    "orders": ["o_custkey", "o_orderstatus", "o_totalprice"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "events": ["user_id", "event_type", "value"],
    "nulls": ["c_custkey", "c_name", "c_acctbal"], "vectors": ["vec_id", "embedding", "label"], "part": ["p_partkey", "p_name", "p_size", "p_retailprice"],
}
TABLES = ("customer", "orders", "events", "embeddings", "part", "nation", "region")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{reverse}", "reverse"), **used)


def _duck(text: str) -> str:
    return text.replace("{reverse}", "list_reverse").format(**{t: t for t in TABLES})


def _sides(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, TableSpec]:
    source, target = (_sql(spark, sf_dir, s) for s in SIDES[name])
    return source, target, TableSpec.of(source.columns, *KEYS[name])


def _compared(name: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target, spec = _sides(spark, sf_dir, name)
        return compare.partition_stats(source, target, spec, domain=PORTABLE, job_id=JOB, **options)

    return run


def _token(key: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def _stats_sql(name: str, reverse: bool = False, skipped: str = "FALSE", sampled: str = "TRUE") -> str:
    """Partition statistics by a full outer join; conditions may use ``token`` and the key ``pk``."""
    (pk,), ck = KEYS[name]
    source, target = (_duck(s) for s in SIDES[name])
    n = len(VALUES[name])
    cluster = "row(" + ", ".join(f"coalesce(s.{c}, t.{c})" for c in ck) + ")" if ck else "0"
    on = " AND ".join(f"s.{c} = t.{c}" for c in [pk, *ck])
    equal = " + ".join(f"CAST(s.{c} IS NOT DISTINCT FROM t.{c} AS INT)" for c in VALUES[name])
    edge, test = ("max", ">") if reverse else ("min", "<")
    return f"""
        s AS (SELECT *, 1 AS here FROM ({source})), t AS (SELECT *, 1 AS here FROM ({target})),
        j AS (SELECT coalesce(s.{pk}, t.{pk}) AS pk, {cluster} AS ck, s.here IS NOT NULL AS in_s, t.here IS NOT NULL AS in_t, {equal} AS equal FROM s FULL JOIN t ON {on}),
        b AS (SELECT *, {edge}(CASE WHEN NOT (in_s AND in_t) THEN ck END) OVER (PARTITION BY pk) AS bad FROM j),
        g AS (SELECT pk, bool_or(in_s) AS has_s, bool_or(in_t) AS has_t, bool_or(bad IS NOT NULL) AS stopped,
                     count(*) FILTER (WHERE in_s AND in_t AND (bad IS NULL OR ck {test} bad)) AS r, coalesce(sum(equal) FILTER (WHERE in_s AND in_t AND (bad IS NULL OR ck {test} bad)), 0) AS v FROM b GROUP BY pk),
        k AS (SELECT *, {_token('pk')} AS token FROM g),
        p AS (SELECT pk AS {pk}, token,
                CASE WHEN NOT has_t THEN 'ONLY_IN_SOURCE' WHEN NOT has_s THEN 'ONLY_IN_TARGET' WHEN {skipped} THEN 'SKIPPED' WHEN NOT stopped AND r * {n} = v THEN 'MATCHED' ELSE 'PARTITION_MISMATCH' END AS status,
                has_s AND has_t AND NOT stopped AS clusterings_match,
                CAST(CASE WHEN has_s AND has_t AND NOT ({skipped}) THEN r ELSE 0 END AS BIGINT) AS matched_rows, CAST(CASE WHEN has_s AND has_t AND NOT ({skipped}) THEN v ELSE 0 END AS BIGINT) AS matched_values,
                CAST(CASE WHEN has_s AND has_t AND NOT ({skipped}) THEN r * {n} - v ELSE 0 END AS BIGINT) AS mismatched_values
              FROM k WHERE NOT (has_s AND has_t) OR ({sampled}))"""


_COUNTERS_SQL = """CAST(count(*) FILTER (WHERE status = 'MATCHED') AS BIGINT) AS matched_partitions, CAST(count(*) FILTER (WHERE status = 'PARTITION_MISMATCH') AS BIGINT) AS mismatched_partitions,
    CAST(0 AS BIGINT) AS error_partitions, CAST(count(*) FILTER (WHERE status = 'SKIPPED') AS BIGINT) AS skipped_partitions, CAST(count(*) FILTER (WHERE status = 'ONLY_IN_SOURCE') AS BIGINT) AS only_in_source,
    CAST(count(*) FILTER (WHERE status = 'ONLY_IN_TARGET') AS BIGINT) AS only_in_target, CAST(coalesce(sum(matched_rows), 0) AS BIGINT) AS matched_rows, CAST(coalesce(sum(matched_values), 0) AS BIGINT) AS matched_values,
    CAST(coalesce(sum(mismatched_values), 0) AS BIGINT) AS mismatched_values"""


def _partitions(query: str, name: str, reverse: bool = False, **options) -> None:
    QUERIES[query] = _compared(name, **options)
    ORACLE_SQL[query] = f"WITH {_stats_sql(name, reverse)} SELECT * FROM p"


def _totals(query: str, name: str, skipped: str = "FALSE", sampled: str = "TRUE", **options) -> None:
    QUERIES[query] = lambda spark, sf_dir: stats.aggregate(_compared(name, **options)(spark, sf_dir))
    ORACLE_SQL[query] = f"WITH {_stats_sql(name, skipped=skipped, sampled=sampled)} SELECT {_COUNTERS_SQL} FROM p"


def _on_stats(query: str, run: Callable[[DataFrame], DataFrame], sql: str, name: str = "orders") -> None:
    QUERIES[query] = lambda spark, sf_dir: run(_compared(name)(spark, sf_dir))
    ORACLE_SQL[query] = f"WITH {_stats_sql(name)} {sql}"


def _on_sides(query: str, run: Callable[[DataFrame, DataFrame, TableSpec], DataFrame], sql: str, name: str = "orders") -> None:
    QUERIES[query] = lambda spark, sf_dir: run(*_sides(spark, sf_dir, name))
    source, target = (_duck(s) for s in SIDES[name])
    ORACLE_SQL[query] = f"WITH s AS ({source}), t AS ({target}) {sql}"


def _on_sql(query: str, run: Callable[..., DataFrame], inputs: list[str], sql: str) -> None:
    """A query over relations that SQL makes from the tables; the oracle sees them as a, b, c."""
    QUERIES[query] = lambda spark, sf_dir: run(*(_sql(spark, sf_dir, i) for i in inputs))
    names = ", ".join(f"{n} AS ({_duck(i)})" for n, i in zip("abc", inputs))
    ORACLE_SQL[query] = f"WITH {names} {sql}"


# splits
_SIZE = PORTABLE.high // SPLITS
_SPLITS_SQL = f"""SELECT CAST(i AS INT) AS split, CAST(i % {BUCKETS} AS INT) AS bucket, CAST(CASE WHEN i = 0 THEN 0 ELSE {_SIZE} * i + 1 END AS BIGINT) AS start_token,
    CAST(CASE WHEN i = {SPLITS - 1} THEN {PORTABLE.high} ELSE {_SIZE} * (i + 1) END AS BIGINT) AS end_token FROM (SELECT unnest(range({SPLITS})) AS i)"""
_SPLIT_OF = f"CAST(least(greatest((token - 1) // {_SIZE}, 0), {SPLITS - 1}) AS INT)"
QUERIES["split_generator"] = lambda spark, sf_dir: splits_frame(spark, SPLITS, BUCKETS, PORTABLE)
ORACLE_SQL["split_generator"] = _SPLITS_SQL
_ACCEPTED = SpecificTokens(frozenset({1, 2**40, 2**59, 2**60 - 1}), Modifier.ACCEPT)


def _accepted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_splits(calculate_splits(SPLITS, BUCKETS, PORTABLE), _ACCEPTED)
    return spark.createDataFrame([(s.number, s.bucket, s.start, s.end) for s in found], "split int, bucket int, start_token bigint, end_token bigint")


QUERIES["split_filter_accept"] = _accepted_splits
ORACLE_SQL["split_filter_accept"] = f"SELECT * FROM ({_SPLITS_SQL}) WHERE " + " OR ".join(f"{t} BETWEEN start_token AND end_token" for t in sorted(_ACCEPTED.tokens))
_on_sides(
    "split_of_key", lambda s, t, spec: keys.key_scan(s, spec, domain=PORTABLE).withColumn("split", split_of(F.col("token"), SPLITS, PORTABLE)),
    f"SELECT token, o_custkey, {_SPLIT_OF} AS split FROM (SELECT DISTINCT {_token('o_custkey')} AS token, o_custkey FROM s)",
)

# key scans, reads and joins
_LOW, _HIGH = 2**58, 2**59
_on_sides("key_scan_range", lambda s, t, spec: keys.key_scan(s, spec, _LOW, _HIGH, PORTABLE), f"SELECT * FROM (SELECT DISTINCT {_token('o_custkey')} AS token, o_custkey FROM s) WHERE token > {_LOW} AND token <= {_HIGH}")
for _name, _back in (("partition_read_fwd", False), ("partition_read_rev", True)):
    _on_sides(_name, lambda s, t, spec, back=_back: keys.partition_read(s, spec, (7,), back, PORTABLE), f"SELECT {_token('o_custkey')} AS token, * FROM s WHERE o_custkey = 7 ORDER BY o_orderkey {'DESC' if _back else ''}")
_KEY_SQL = f"SELECT {_token('k')} AS token, k AS o_custkey"
_on_sides("key_join", lambda s, t, spec: keys.key_join(s, t, spec, PORTABLE), f"{_KEY_SQL}, k IN (SELECT o_custkey FROM s) AS in_source, k IN (SELECT o_custkey FROM t) AS in_target FROM (SELECT o_custkey AS k FROM s UNION SELECT o_custkey FROM t)")
_on_sides("keys_only_in_source", lambda s, t, spec: keys.only_in_source(s, t, spec, PORTABLE), f"{_KEY_SQL} FROM (SELECT o_custkey AS k FROM s EXCEPT SELECT o_custkey FROM t)")
_on_sides("keys_only_in_target", lambda s, t, spec: keys.only_in_target(s, t, spec, PORTABLE), f"{_KEY_SQL} FROM (SELECT o_custkey AS k FROM t EXCEPT SELECT o_custkey FROM s)")
_on_sides("keys_in_both", lambda s, t, spec: keys.in_both(s, t, spec, PORTABLE), f"{_KEY_SQL} FROM (SELECT o_custkey AS k FROM s INTERSECT SELECT o_custkey FROM t)")

# row comparison
_partitions("partition_stats_narrow", "customer")
_partitions("partition_stats_wide", "orders")
_partitions("partition_stats_compound", "events")
_partitions("partition_stats_colocated", "orders", plan="colocated")
_partitions("partition_stats_positional", "orders", plan="positional")
_partitions("partition_stats_reverse", "orders", reverse=True, reverse_probability=1.0)
_partitions("partition_stats_positional_reverse", "orders", reverse=True, reverse_probability=1.0, plan="positional")
_partitions("null_value_compare", "nulls")
_partitions("array_value_compare", "vectors")


#: Both sides with a number as text, some of it broken on either side.
_TEXT = "CASE WHEN c_custkey % 29 = {0} THEN 'n/a' ELSE CAST(CAST(c_acctbal * 100 AS BIGINT) AS {{text}}) END AS c_acctbal"
_BROKEN = [f"SELECT c_custkey, {_TEXT.format(r)} FROM {{customer}} WHERE c_custkey % 17 <> {r}" for r in (3, 5)]


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = (compare.readable(_sql(spark, sf_dir, s.replace("{text}", "STRING")), {"c_acctbal": "bigint"}) for s in _BROKEN)
    return compare.partition_stats(source, target, TableSpec.of(["c_custkey", "c_acctbal"], ["c_custkey"]), domain=PORTABLE)


_BROKEN_SQL = """s AS (SELECT *, 1 AS here FROM ({0})), t AS (SELECT *, 1 AS here FROM ({1})),
    p AS (SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, {2} AS token, s.c_custkey IS NOT NULL AND t.c_custkey IS NOT NULL AS clusterings_match,
        CASE WHEN t.here IS NULL THEN 'ONLY_IN_SOURCE' WHEN s.here IS NULL THEN 'ONLY_IN_TARGET' WHEN s.c_acctbal = 'n/a' OR t.c_acctbal = 'n/a' THEN 'ERROR' ELSE 'MATCHED' END AS status,
        CAST(CASE WHEN s.here = t.here AND s.c_acctbal <> 'n/a' AND t.c_acctbal <> 'n/a' THEN 1 ELSE 0 END AS BIGINT) AS matched_rows FROM s FULL JOIN t ON s.c_custkey = t.c_custkey),
    q AS (SELECT *, matched_rows * 2 AS matched_values, CAST(0 AS BIGINT) AS mismatched_values FROM p)""".format(
    *(_duck(s.replace("{text}", "VARCHAR")) for s in _BROKEN), _token("coalesce(s.c_custkey, t.c_custkey)")
)
QUERIES["partition_errors"] = _broken
ORACLE_SQL["partition_errors"] = f"WITH {_BROKEN_SQL} SELECT * FROM q"
_COUNT_ERRORS = _COUNTERS_SQL.replace("CAST(0 AS BIGINT) AS error_partitions", "CAST(count(*) FILTER (WHERE status = 'ERROR') AS BIGINT) AS error_partitions")
QUERIES["table_stats_with_errors"] = lambda spark, sf_dir: stats.aggregate(_broken(spark, sf_dir))
ORACLE_SQL["table_stats_with_errors"] = f"WITH {_BROKEN_SQL} SELECT {_COUNT_ERRORS} FROM q"
_BLAME = "SELECT c_custkey AS p0, min(side) AS error_source FROM (SELECT c_custkey, c_acctbal, 'SOURCE' AS side FROM s UNION ALL SELECT c_custkey, c_acctbal, 'TARGET' FROM t) WHERE c_acctbal = 'n/a' GROUP BY c_custkey"
QUERIES["errors_by_side"] = lambda spark, sf_dir: compare.broken_partitions(*(compare.readable(_sql(spark, sf_dir, s.replace("{text}", "STRING")), {"c_acctbal": "bigint"}) for s in _BROKEN), TableSpec.of(["c_custkey", "c_acctbal"], ["c_custkey"]))
ORACLE_SQL["errors_by_side"] = f"WITH {_BROKEN_SQL} {_BLAME}"


def _maps(spark: SparkSession, sf_dir: str, first: str, second: str, sets: tuple[str, ...] = ()) -> DataFrame:
    source, target = (_sql(spark, sf_dir, f"SELECT c_custkey, {x} AS m FROM {{customer}}") for x in (first, second))
    return compare.partition_stats(source, target, TableSpec.of(source.columns, ["c_custkey"], sets=sets), domain=PORTABLE)


_BUMPED = "CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END"
QUERIES["map_value_compare"] = lambda spark, sf_dir: _maps(spark, sf_dir, "map('a', CAST(c_nationkey AS DOUBLE), 'b', c_acctbal)", f"map('b', {_BUMPED}, 'a', CAST(c_nationkey AS DOUBLE))")
QUERIES["set_value_compare"] = lambda spark, sf_dir: _maps(spark, sf_dir, "array(CAST(c_nationkey AS DOUBLE), c_acctbal)", f"array({_BUMPED}, CAST(c_nationkey AS DOUBLE))", ("m",))
for _name in ("map_value_compare", "set_value_compare"):
    ORACLE_SQL[_name] = f"""SELECT c_custkey, {_token('c_custkey')} AS token, CASE WHEN c_custkey % 4 = 0 THEN 'PARTITION_MISMATCH' ELSE 'MATCHED' END AS status, TRUE AS clusterings_match, CAST(1 AS BIGINT) AS matched_rows,
        CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS matched_values, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS mismatched_values FROM customer"""

# statistics
_totals("table_stats", "orders")
_totals("table_stats_narrow", "customer")
_totals("table_stats_compound", "events")


def _md5_tokens(modifier: Modifier) -> SpecificTokens:
    import hashlib

    return SpecificTokens(frozenset(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in range(0, 200, 3)), modifier)


_TOKEN_LIST = ", ".join(map(str, sorted(_md5_tokens(Modifier.ACCEPT).tokens)))
_totals("token_accept", "orders", skipped=f"token NOT IN ({_TOKEN_LIST})", tokens=_md5_tokens(Modifier.ACCEPT))
_totals("token_reject", "orders", skipped=f"token IN ({_TOKEN_LIST})", tokens=_md5_tokens(Modifier.REJECT))
_totals("sampled_table_stats", "orders", sampled=f"CAST('0x' || substr(md5('{JOB}:' || CAST(pk AS VARCHAR)), 1, 15) AS BIGINT) % 1000000 < 300000", sampling=0.3)
_on_stats("partition_classification", lambda p: p.groupBy("status").agg(F.count(F.lit(1)).alias("partitions")), "SELECT status, CAST(count(*) AS BIGINT) AS partitions FROM p GROUP BY status")
_on_stats(
    "range_stats_by_split", lambda p: stats.by_split(p, SPLITS, PORTABLE).drop("highest_token"),
    f"SELECT {_SPLIT_OF} AS split, {_COUNTERS_SQL} FROM p GROUP BY 1",
)
_on_stats("highest_token_by_split", lambda p: stats.by_split(p, SPLITS, PORTABLE).select("split", "highest_token"), f"SELECT {_SPLIT_OF} AS split, max(token) AS highest_token FROM p GROUP BY 1")
_on_stats(
    "accumulated_stats", lambda p: stats.accumulate(stats.by_split(p, SPLITS, PORTABLE)), f"SELECT {_COUNTERS_SQL} FROM p",
)
_on_stats("mismatch_journal", compare.mismatches, "SELECT token, status AS mismatch_type FROM p WHERE status NOT IN ('MATCHED', 'SKIPPED')")
_ONE_LINE = " || ', ' || ".join(f"'{label} - ' || {c}" for label, c in zip((x.split(" - ")[0] for x in stats.SUMMARY.split(", ")), stats.SUMMARY_ORDER, strict=True))
_on_stats(
    "stats_verdicts", lambda p: stats.verdicts(stats.by_split(p, SPLITS, PORTABLE).drop("highest_token")),
    f"""SELECT *, only_in_source = 0 AND only_in_target = 0 AND error_partitions = 0 AND mismatched_values = 0 AND skipped_partitions = 0 AS all_matches, {' AND '.join(f'{c} = 0' for c in stats.COUNTERS)} AS is_empty,
        {_ONE_LINE} AS summary FROM (SELECT {_SPLIT_OF} AS split, {_COUNTERS_SQL} FROM p GROUP BY 1)""",
)
_SEVERAL = ("orders", "customer", "part")


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_compared(n)(spark, sf_dir).select(F.lit(f"test.{n}").alias("qualified_table_name"), "status", *compare.COUNTS) for n in _SEVERAL]
    return stats.aggregate(parts[0].union(parts[1]).union(parts[2]), ["qualified_table_name"])


QUERIES["multi_table_stats"] = _several
ORACLE_SQL["multi_table_stats"] = " UNION ALL ".join(f"SELECT * FROM (WITH {_stats_sql(n)} SELECT 'test.{n}' AS qualified_table_name, {_COUNTERS_SQL} FROM p)" for n in _SEVERAL)
_on_sides("repeated_keys", lambda s, t, spec: compare.repeated_keys(s.select("o_custkey", "o_orderstatus"), TableSpec.of(["o_custkey", "o_orderstatus"], ["o_custkey"], ["o_orderstatus"])), "SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS rows FROM s GROUP BY ALL HAVING count(*) > 1")

# sides without rows, ranges without tokens
for _name, _none in (("source_empty", "source"), ("target_empty", "target")):
    _on_sides(
        f"key_join_{_name}", lambda s, t, spec, none=_none: keys.key_join(s.limit(0) if none == "source" else s, t.limit(0) if none == "target" else t, spec, PORTABLE),
        f"{_KEY_SQL}, {'FALSE' if _none == 'source' else 'TRUE'} AS in_source, {'TRUE' if _none == 'source' else 'FALSE'} AS in_target FROM (SELECT DISTINCT o_custkey AS k FROM {'t' if _none == 'source' else 's'})",
    )
_on_sides("key_scan_empty_range", lambda s, t, spec: keys.key_scan(s, spec, _LOW, _LOW, PORTABLE), f"{_KEY_SQL} FROM (SELECT o_custkey AS k FROM s WHERE FALSE)")


def _default_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, f"key-{k}") for k in range(-20, 20)], "k bigint, name string").select("k", token([F.col("k")]).alias("token"), "name", token([F.col("name")]).alias("name_token"))


def _xxhash64(raw: bytes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(raw, 42)
    return x - (1 << 64) if x >> 63 else x


QUERIES["default_tokens"] = _default_tokens
ORACLE_SQL["default_tokens"] = "SELECT CAST(k AS BIGINT) AS k, CAST(token AS BIGINT) AS token, name, CAST(name_token AS BIGINT) AS name_token FROM (VALUES " + ", ".join(
    f"({k}, {_xxhash64(k.to_bytes(8, 'little', signed=True))}, 'key-{k}', {_xxhash64(f'key-{k}'.encode())})" for k in range(-20, 20)
) + ") AS v(k, token, name, name_token)"
QUERIES["default_splits"] = lambda spark, sf_dir: splits_frame(spark, SPLITS, BUCKETS, MURMUR3)
ORACLE_SQL["default_splits"] = "SELECT CAST(split AS INT) AS split, CAST(bucket AS INT) AS bucket, CAST(s AS BIGINT) AS start_token, CAST(e AS BIGINT) AS end_token FROM (VALUES " + ", ".join(
    f"({i}, {i % BUCKETS}, '{-2**63 + (2**64 - 1) // SPLITS * i + (i > 0)}', '{2**63 - 1 if i == SPLITS - 1 else -2**63 + (2**64 - 1) // SPLITS * (i + 1)}')" for i in range(SPLITS)
) + ") AS v(split, bucket, s, e)"
_RANGES = [(None, 5), (5, None), (5, 5), (6, 5), (-1, 5), (0, 1), (0, 2**60 - 1), (0, 2**60), (7, 2**59)]


def _range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def holds(low: int | None, high: int | None) -> bool:
        try:
            check_range(low, high, PORTABLE)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(str(low), str(high), holds(low, high)) for low, high in _RANGES], "low string, high string, valid boolean")


QUERIES["range_checks"] = _range_checks
_LIMITS = "CAST(nullif(low, 'None') AS HUGEINT) >= 0 AND CAST(nullif(low, 'None') AS HUGEINT) < CAST(nullif(high, 'None') AS HUGEINT) AND CAST(nullif(high, 'None') AS HUGEINT) <= {0}".format(PORTABLE.high)
ORACLE_SQL["range_checks"] = f"SELECT *, coalesce({_LIMITS}, FALSE) AS valid FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _RANGES)}) AS v(low, high)"


def _pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = strategy(RetryOptions("exponential", 10, 1000))()
    return spark.createDataFrame([(i, own.pause_ms()) for i in range(12)], "attempt int, pause_ms bigint")


QUERIES["retry_pauses"] = _pauses
ORACLE_SQL["retry_pauses"] = """WITH p AS (SELECT i, 10 * power(2, i) AS full_pause, 10 * (power(2, i) - 1) AS before FROM (SELECT unnest(range(12)) AS i))
    SELECT CAST(i AS INT) AS attempt, CAST(CASE WHEN before >= 1000 THEN -1 ELSE least(full_pause, 1000 - before) END AS BIGINT) AS pause_ms FROM p"""

# sets of tables
_KEYSPACES = "SELECT concat(CASE WHEN n_regionkey = 0 THEN 'system' ELSE concat('ks', CAST(n_regionkey AS STRING)) END, '.', n_name) AS qualified_table_name FROM {nation}"
_on_sql("disallowed_keyspaces", lambda a: allowed_tables(a, ["ks2", "ks4"]), [_KEYSPACES], "SELECT * FROM a WHERE split_part(qualified_table_name, '.', 1) NOT IN ('system', 'ks2', 'ks4')")
_NATIONS = ["SELECT concat('ks.', n_name) AS qualified_table_name FROM {nation} WHERE n_nationkey % 3 <> 0", "SELECT concat('ks.', n_name) AS qualified_table_name FROM {nation} WHERE n_nationkey % 2 = 0"]
_on_sql("schema_intersect", intersect_frame, _NATIONS, "SELECT * FROM a INTERSECT SELECT * FROM b")
_on_sql("schema_difference", difference_frame, _NATIONS, "SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")

# the journal, as if jobs had filed these rows
_SPLIT_ROWS = "SELECT CAST(c_custkey AS INT) AS split, CAST(c_custkey % 7 AS INT) AS bucket, c_custkey * 1000 AS start_token, c_custkey * 1000 + 999 AS end_token FROM {customer}"
_STATUS_ROWS = "SELECT CAST(c_custkey AS INT) AS split, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1000 + 999 ELSE c_custkey * 1000 + 5 END AS last_token, CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_custkey END AS matched_rows FROM {customer} WHERE c_custkey % 3 <> 0"
_on_sql("resume_filter", lambda a, b: open_splits(a, b), [_SPLIT_ROWS, _STATUS_ROWS], "SELECT a.*, last_token AS resume_after, coalesce(matched_rows, 0) AS matched_rows FROM a LEFT JOIN b USING (split) WHERE last_token IS DISTINCT FROM end_token")
_on_sql("resume_filter_all", lambda a, b: open_splits(a, b, True), [_SPLIT_ROWS, _STATUS_ROWS], "SELECT a.*, CAST(NULL AS BIGINT) AS resume_after, coalesce(matched_rows, 0) AS matched_rows FROM a LEFT JOIN b USING (split)")
_TASKS = """SELECT concat('job', CAST(o_custkey % 3 AS STRING)) AS job_id, CAST(o_custkey % 10 AS INT) AS bucket, concat('ks.t', CAST(o_custkey % 4 AS STRING)) AS qualified_table_name, CAST(o_custkey * 100 AS STRING) AS start_token,
    CAST(o_custkey * 100 + 99 AS STRING) AS end_token, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 100 + 99 ELSE o_custkey * 100 END AS STRING) AS last_token, o_orderkey AS matched_rows, o_orderkey AS written_at FROM {orders}"""
_TASK_KEY = ["job_id", "bucket", "qualified_table_name", "start_token", "end_token"]
_LATEST = f"SELECT * EXCLUDE (written_at) FROM a QUALIFY row_number() OVER (PARTITION BY {', '.join(_TASK_KEY)} ORDER BY written_at DESC) = 1"
_on_sql("task_status_latest", lambda a: latest_rows(a, _TASK_KEY), [_TASKS], _LATEST)
_on_sql("job_status_completed", lambda a: report.completed(latest_rows(a, _TASK_KEY), "job1"), [_TASKS], f"SELECT qualified_table_name, CAST(count(*) AS BIGINT) AS completed FROM ({_LATEST}) WHERE job_id = 'job1' AND last_token = end_token GROUP BY 1")
_MISSES = """SELECT concat('job', CAST(c_custkey % 3 AS STRING)) AS job_id, CAST(c_custkey % 10 AS INT) AS bucket, concat('ks.t', CAST(c_custkey % 4 AS STRING)) AS qualified_table_name, CAST(c_custkey * 100 AS STRING) AS mismatching_token,
    CASE WHEN c_custkey % 2 = 0 THEN 'ONLY_IN_SOURCE' ELSE 'PARTITION_MISMATCH' END AS mismatch_type FROM {customer}"""
_on_sql(
    "job_mismatches", lambda a: report.mismatches(a, "job1").select("qualified_table_name", F.array_join(F.transform("mismatches", lambda m: F.concat(m["token"], F.lit("/"), m["type"])), ",").alias("mismatches")), [_MISSES],
    "SELECT qualified_table_name, string_agg(mismatching_token || '/' || mismatch_type, ',' ORDER BY mismatching_token, mismatch_type) AS mismatches FROM a WHERE job_id = 'job1' GROUP BY 1",
)
_ERRORS = """SELECT concat('job', CAST(c_custkey % 3 AS STRING)) AS job_id, CAST(c_custkey % 10 AS INT) AS bucket, concat('ks.t', CAST(c_custkey % 4 AS STRING)) AS qualified_table_name, CAST(c_custkey * 100 AS STRING) AS start_token,
    CAST(c_custkey * 100 + 99 AS STRING) AS end_token FROM {customer} WHERE c_custkey % 5 = 0"""
_DETAILS = """SELECT concat('job', CAST(o_custkey % 3 AS STRING)) AS job_id, CAST(o_custkey % 10 AS INT) AS bucket, concat('ks.t', CAST(o_custkey % 4 AS STRING)) AS qualified_table_name, CAST(o_custkey * 100 AS STRING) AS start_token,
    CAST(o_custkey * 100 + 99 AS STRING) AS end_token, CAST(o_orderkey AS STRING) AS error_token, 'SOURCE' AS error_source FROM {orders}"""
_RESULTS = """SELECT concat('job', CAST(c_custkey % 5 AS STRING)) AS job_id, concat('ks.t', CAST(c_custkey % 7 AS STRING)) AS qualified_table_name, CAST(c_custkey AS BIGINT) AS matched_partitions FROM {customer} WHERE c_custkey <= 35"""
_NAMED = "SELECT concat('job', CAST(n_nationkey AS STRING)) AS job_id, concat('ks.t', CAST(n_regionkey AS STRING)) AS named FROM {nation} WHERE n_nationkey < 5"


def _results(found: DataFrame, named: DataFrame) -> DataFrame:
    zeros = {c: F.lit(0).cast("bigint") for c in stats.COUNTERS if c != "matched_partitions"}
    summary = named.select("job_id", F.array("named", F.lit("ks.t5"), F.lit("ks.t6")).alias("qualified_table_names"))
    return report.results(summary, found.withColumns(zeros), "job1")


_on_sql(
    "job_results", _results, [_RESULTS, _NAMED],
    f"SELECT qualified_table_name, {', '.join('matched_partitions' if c == 'matched_partitions' else f'CAST(0 AS BIGINT) AS {c}' for c in stats.COUNTERS)} FROM a WHERE job_id = 'job1' AND (qualified_table_name IN ('ks.t5', 'ks.t6') OR qualified_table_name IN (SELECT named FROM b WHERE job_id = 'job1'))",
)
_on_sql("error_summary", lambda a: report.error_summary(a, "job1"), [_ERRORS], "SELECT qualified_table_name, CAST(count(*) AS BIGINT) AS errors FROM a WHERE job_id = 'job1' GROUP BY 1")
_on_sql(
    "error_ranges", lambda a: report.error_ranges(a, "job1").select("qualified_table_name", F.array_join(F.transform("ranges", lambda r: F.concat(r["start"], F.lit("-"), r["end"])), ",").alias("ranges")), [_ERRORS],
    "SELECT qualified_table_name, string_agg(start_token || '-' || end_token, ',' ORDER BY start_token, end_token) AS ranges FROM a WHERE job_id = 'job1' GROUP BY 1",
)
_on_sql(
    "error_detail", lambda a, b: report.error_tokens(a, b, "job1").select("qualified_table_name", F.array_join("tokens", ",").alias("tokens")), [_ERRORS, _DETAILS],
    f"SELECT qualified_table_name, string_agg(error_token, ',' ORDER BY error_token) AS tokens FROM a JOIN b USING ({', '.join(_TASK_KEY)}) WHERE job_id = 'job1' GROUP BY 1",
)
_JOBS = """SELECT concat('job', CAST(c_custkey AS STRING)) AS job_id, CAST(o_first AS TIMESTAMP) AS job_start_time, concat('src', CAST(c_nationkey % 3 AS STRING)) AS source_cluster_name, concat('tgt', CAST(c_nationkey % 4 AS STRING)) AS target_cluster_name,
    concat('ks', CAST(c_custkey % 5 AS STRING), '.t1') AS first_table FROM (SELECT c_custkey, c_nationkey, max(o_orderdate) AS o_first FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey)"""
_on_sql("jobs_between", lambda a: report.jobs_between(a, date(1998, 6, 1), date(1998, 8, 15)), [_JOBS], "SELECT * FROM a WHERE CAST(job_start_time AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-08-15'")
_on_sql("jobs_by_source", lambda a: report.by_source(a, "src1"), [_JOBS], "SELECT * FROM a WHERE source_cluster_name = 'src1'")
_on_sql("jobs_by_target", lambda a: report.by_target(a, "tgt2"), [_JOBS], "SELECT * FROM a WHERE target_cluster_name = 'tgt2'")
_on_sql("jobs_by_keyspace", lambda a: report.by_keyspace(a.withColumn("qualified_table_names", F.array("first_table")), "ks3").drop("qualified_table_names"), [_JOBS], "SELECT * FROM a WHERE first_table LIKE 'ks3.%'")
_on_sql(
    "recent_jobs", lambda a: report.recent_jobs(a, date(1998, 8, 31)), [_JOBS],
    """, d AS (SELECT *, floor((DATE '1998-08-31' - CAST(job_start_time AS DATE)) / 30) AS age FROM a WHERE CAST(job_start_time AS DATE) <= DATE '1998-08-31'),
       n AS (SELECT CASE WHEN count(*) FILTER (WHERE age <= 0) >= 10 THEN 0 WHEN count(*) FILTER (WHERE age <= 1) >= 10 THEN 1 ELSE 2 END AS most FROM d) SELECT d.* EXCLUDE (age) FROM d, n WHERE age <= most""",
)
_RUNNING = "SELECT concat('job', CAST(c_custkey AS STRING)) AS job_id FROM {customer} WHERE c_custkey % 11 = 0"
_on_sql("running_jobs", report.running_jobs, [_JOBS, _RUNNING], "SELECT * FROM a WHERE job_id IN (SELECT job_id FROM b)")
_on_sql("running_job_ids", report.running_ids, [_RUNNING], "SELECT job_id FROM a")
_on_sql("job_summary", lambda a: report.job(a, "job7"), [_JOBS], "SELECT * FROM a WHERE job_id = 'job7'")

# whole jobs, filed in a journal and read back from it


class _Tables:
    """A side of the comparisons in ``SIDES``."""

    partitioner = PORTABLE.name

    def __init__(self, sf_dir: str, side: int):
        self.sf_dir, self.side, self.name = sf_dir, side, ("source", "target")[side]

    def initialize(self, options: dict, name: str) -> None:
        pass

    def table(self, spark: SparkSession, name: TableName) -> DataFrame:
        return _sql(spark, self.sf_dir, SIDES[name.table][self.side])

    def schema(self, spark: SparkSession, disallowed) -> Schema:
        names = ("customer", "part", "orders" if self.side else "nulls")
        return Schema(TableName(k, t) for k in ("test", "hidden") if k not in excluded(disallowed) for t in names)

    def description(self) -> str:
        return self.name


def _journal_of_a_job(spark: SparkSession, sf_dir: str) -> tuple[Journal, str]:
    """A journal in the session's warehouse, removed when the driver ends, with a job on the tables that both sides have."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/collatio-journal-{new_id()}"
    atexit.register(lambda: suppressed(lambda: remove(spark, root)))
    journal, job_id = Journal(spark, root, MetadataOptions(should_init=True)), "00000000-0000-0000-0000-00000000000a"
    shapes = {f"test.{t}": {"partition_key": KEYS[t][0], "plan": "spread"} for t in ("customer", "part")}
    config = JobConfig(splits=SPLITS, buckets=BUCKETS, waves=2, table_specs=shapes, disallowed_keyspaces=("hidden",), job_id=UUID(job_id))
    DiffJob(spark, config, journal, source=_Tables(sf_dir, 0), target=_Tables(sf_dir, 1)).run()
    return journal, job_id


def suppressed(call: Callable[[], None]) -> None:
    with contextlib.suppress(Exception):
        call()


_FILED = ("customer", "part")


def _job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal, job_id = _journal_of_a_job(spark, sf_dir)
    return journal.read("job_results", job_id).select("qualified_table_name", *stats.COUNTERS)


def _job_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal, job_id = _journal_of_a_job(spark, sf_dir)
    status = report.completed(journal.read("task_status", job_id), job_id).select(F.lit("completed").alias("what"), "qualified_table_name", F.col("completed").alias("n"))
    found = journal.read("mismatches", job_id).groupBy("mismatch_type", "qualified_table_name").agg(F.count(F.lit(1)).alias("n"))
    running = journal.read("running_jobs").agg(F.count(F.lit(1)).alias("n")).select(F.lit("running").alias("what"), F.lit("").alias("qualified_table_name"), "n")
    return status.union(found).union(running)


QUERIES["job_run"] = _job_run
ORACLE_SQL["job_run"] = " UNION ALL ".join(f"SELECT * FROM (WITH {_stats_sql(n)} SELECT 'test.{n}' AS qualified_table_name, {_COUNTERS_SQL} FROM p)" for n in _FILED)
QUERIES["job_journal"] = _job_journal
ORACLE_SQL["job_journal"] = " UNION ALL ".join(
    [f"SELECT 'completed' AS what, 'test.{n}' AS qualified_table_name, CAST({SPLITS} AS BIGINT) AS n" for n in _FILED]
    + [f"SELECT * FROM (WITH {_stats_sql(n)} SELECT status AS what, 'test.{n}' AS qualified_table_name, CAST(count(*) AS BIGINT) AS n FROM p WHERE status NOT IN ('MATCHED', 'SKIPPED') GROUP BY status)" for n in _FILED]
    + ["SELECT 'running' AS what, '' AS qualified_table_name, CAST(0 AS BIGINT) AS n"]
)
