"""Row comparison: fixed cases, and all plans against a step-by-step simulator on random partitions."""

import random

import pytest

from collatio.functions.tokens import PORTABLE
from collatio.operators.compare import mismatches, partition_stats, repeated_keys
from collatio.operators.stats import RangeStats, aggregate, verdicts
from collatio.spec import Modifier, SpecificTokens, TableSpec

#: clustering columns, source rows, target rows; clusterings match, matched rows, matched values, mismatched values (of v1, v2)
CASES = {
    "extra at source start": ("c1 c2", [(0, 1, 2, 3), (10, 11, 12, 13)], [(10, 11, 12, 13)], (False, 0, 0, 0)),
    "extra at target start": ("c1 c2", [(10, 11, 12, 13)], [(0, 1, 2, 3), (10, 11, 12, 13)], (False, 0, 0, 0)),
    "extra at source end": ("c1 c2", [(0, 1, 2, 3), (10, 11, 12, 13)], [(0, 1, 2, 3)], (False, 1, 2, 0)),
    "extra at target end": ("c1 c2", [(0, 1, 2, 3)], [(0, 1, 2, 3), (10, 11, 12, 13)], (False, 1, 2, 0)),
    "no clustering, all match": ("", [(0, 1), (1, 11), (2, 12)], [(0, 1), (1, 11), (2, 12)], (True, 3, 6, 0)),
    "one clustering, all match": ("c1", [(0, 1, 2), (1, 11, 12), (2, 21, 22)], [(0, 1, 2), (1, 11, 12), (2, 21, 22)], (True, 3, 6, 0)),
    "two clusterings, all match": ("c1 c2", [(0, 1, 2, 3), (1, 11, 12, 13), (2, 21, 22, 23)], [(0, 1, 2, 3), (1, 11, 12, 13), (2, 21, 22, 23)], (True, 3, 6, 0)),
    "no clustering, mismatches": ("", [(0, 1), (1, 11), (2, 12)], [(0, 1), (1, 1100), (2, 1200)], (True, 3, 4, 2)),
    "one clustering, mismatches": ("c1", [(0, 1, 2), (1, 11, 21), (2, 12, 22)], [(0, 1, 20), (1, 1100, 21), (2, 12, 1200)], (True, 3, 3, 3)),
}


@pytest.mark.parametrize("name", CASES)
def test_fixed_cases(spark, name):
    ck, source, target, expected = CASES[name]
    ck = ck.split()
    columns = ["pk", *ck, "v1", "v2"]
    a, b = (spark.createDataFrame([(1, *r) for r in rows], ", ".join(f"{c} int" for c in columns)) for rows in (source, target))
    plans = ["positional"] if not ck else ["spread", "colocated", "positional"]
    for plan in plans:
        row = partition_stats(a, b, TableSpec.of(columns, ["pk"], ck), plan=plan).first()
        pk_values = expected[1]  # the key column is a value that always matches
        assert (row["clusterings_match"], row["matched_rows"], row["matched_values"] - pk_values, row["mismatched_values"]) == expected, plan


def simulate(source, target, reverse=False):
    """Two sorted lists of (ck, values) in step; stops where the clusterings differ."""
    source, target = sorted(source, reverse=reverse), sorted(target, reverse=reverse)
    rows = good = bad = 0
    same = len(source) == len(target)
    for (c, v), (d, w) in zip(source, target):
        if c != d:
            same = False
            break
        rows += 1
        good += sum(x == y for x, y in zip(v, w)) + 1
        bad += sum(x != y for x, y in zip(v, w))
    return same, rows, good, bad


def random_sides(seed, partitions=120):
    rng = random.Random(seed)
    sides = ({}, {})
    for pk in range(partitions):
        base = {c: (rng.choice([None, 1, 2]), rng.choice(["a", "b", None])) for c in rng.sample(range(12), rng.randrange(0, 9))}
        for side in sides:
            rows = {c: v if rng.random() < 0.85 else (rng.choice([None, 1, 2]), "z") for c, v in base.items() if rng.random() < 0.95}
            if rng.random() < 0.1:
                rows[rng.randrange(20, 30)] = (5, "n")
            side[pk] = rows
    return sides


@pytest.mark.parametrize("reverse", [False, True])
def test_plans_agree_with_the_simulator(spark, reverse):
    sides = random_sides(3)
    frames = [spark.createDataFrame([(pk, c, *v) for pk, rows in side.items() for c, v in rows.items()], "pk int, ck int, a int, b string") for side in sides]
    spec = TableSpec.of(frames[0].columns, ["pk"], ["ck"])
    expected = {}
    for pk in sides[0]:
        s, t = (list(side[pk].items()) for side in sides)
        if not s and not t:
            continue
        if not s or not t:
            expected[pk] = ("ONLY_IN_SOURCE" if s else "ONLY_IN_TARGET", 0, 0, 0)
            continue
        same, rows, good, bad = simulate(s, t, reverse)
        expected[pk] = ("MATCHED" if same and not bad else "PARTITION_MISMATCH", rows, good, bad)
    for plan in ("spread", "colocated", "positional"):
        got = partition_stats(*frames, spec, plan=plan, reverse_probability=float(reverse)).collect()
        assert {r["pk"]: (r["status"], r["matched_rows"], r["matched_values"], r["mismatched_values"]) for r in got} == expected, plan


def test_falling_and_mixed_clustering_orders(spark):
    a = spark.createDataFrame([(1, 3, "x", 0), (1, 2, "x", 0), (1, 1, "x", 0)], "pk int, c int, d string, v int")
    b = spark.createDataFrame([(1, 3, "x", 0), (1, 1, "x", 0)], "pk int, c int, d string, v int")
    for clustering, falling in ((["c"], ["c"]), (["c", "d"], ["c"]), (["c", "d"], ["c", "d"]), (["d", "c"], ["c"])):
        spec = TableSpec.of(a.columns, ["pk"], clustering, falling)
        assert partition_stats(a, b, spec).first()["matched_rows"] == 1  # 3 alone stands before the gap
    # a falling text among rising columns has no rising key, so rows are numbered
    assert partition_stats(a, b, TableSpec.of(a.columns, ["pk"], ["c", "d"], ["d"])).first()["matched_rows"] == 1


def test_null_clusterings_and_values(spark):
    a = spark.createDataFrame([(1, None, None), (1, 1, 5)], "pk int, c int, v int")
    b = spark.createDataFrame([(1, None, None), (1, 1, None)], "pk int, c int, v int")
    for plan in ("spread", "colocated", "positional"):
        row = partition_stats(a, b, TableSpec.of(a.columns, ["pk"], ["c"]), plan=plan).first()
        assert (row["clusterings_match"], row["matched_rows"], row["matched_values"], row["mismatched_values"]) == (True, 2, 3, 1)


def test_null_partition_keys_are_keys(spark):
    a = spark.createDataFrame([(None, 1, 5)], "pk int, c int, v int")
    for plan in ("spread", "colocated", "positional"):
        assert partition_stats(a, a, TableSpec.of(a.columns, ["pk"], ["c"]), plan=plan).first()["status"] == "MATCHED"


def test_floats_maps_sets_and_structs(spark):
    row = "SELECT 1 AS pk, map('a', 1, 'b', 2) AS m, array(1, 2) AS s, named_struct('m', map(1, 2, 3, 4)) AS n, CAST('NaN' AS DOUBLE) AS f, 0.0D AS z, array(map('k', 1)) AS l"
    other = "SELECT 1 AS pk, map('b', 2, 'a', 1) AS m, array(2, 1) AS s, named_struct('m', map(3, 4, 1, 2)) AS n, CAST('NaN' AS DOUBLE) AS f, -0.0D AS z, array(map('k', 1)) AS l"
    a, b = spark.sql(row), spark.sql(other)
    spec = TableSpec.of(a.columns, ["pk"], sets=["s"])
    assert partition_stats(a, b, spec).first()["mismatched_values"] == 0
    assert partition_stats(a, b, spec, strict_float=True).first()["mismatched_values"] == 1
    assert partition_stats(a, b, TableSpec.of(a.columns, ["pk"])).first()["mismatched_values"] == 1


def keyed(spark, tokens):
    return spark.createDataFrame([(t,) for t in tokens], "pk int")


KEY_CASES = [
    (range(7), [0, 1, 2, 3, 4, 5, 7], (6, 1, 1)), ([], [], (0, 0, 0)), ([0, 1, 2], [0, 1], (2, 1, 0)), ([7, 8], [7, 8, 9], (2, 0, 1)), (range(4, 9), [4, 5], (2, 3, 0)),
    ([4, 5], range(4, 9), (2, 0, 3)), ([0, 1, 3, 5, 7, 9], [0, 2, 4, 6, 8, 9], (2, 4, 4)), ([], [4, 5], (0, 0, 2)), ([4, 5], [], (0, 2, 0)),
]


@pytest.mark.parametrize("source, target, expected", KEY_CASES)
def test_key_streams(spark, source, target, expected):
    a, b = keyed(spark, source), keyed(spark, target)
    row = aggregate(partition_stats(a, b, TableSpec.of(["pk"], ["pk"]))).first()
    assert (row["matched_partitions"], row["only_in_source"], row["only_in_target"]) == expected


def test_tokens_skip_only_keys_of_both_sides(spark):
    a, b = keyed(spark, range(7)), keyed(spark, range(1, 8))
    spec = TableSpec.of(["pk"], ["pk"])
    tokens = {r["pk"]: r["token"] for r in partition_stats(a, b, spec, domain=PORTABLE).collect()}
    listed = frozenset(tokens[k] for k in (0, 2, 3, 4))
    for modifier, expected in ((Modifier.REJECT, (3, 3)), (Modifier.ACCEPT, (3, 3))):
        row = aggregate(partition_stats(a, b, spec, domain=PORTABLE, tokens=SpecificTokens(listed, modifier))).first()
        assert (row["matched_partitions"], row["skipped_partitions"]) == expected
        assert (row["only_in_source"], row["only_in_target"]) == (1, 1)


def test_sampling_is_repeatable_and_keeps_lone_keys(spark):
    a, b = keyed(spark, range(1000)), keyed(spark, range(10, 1010))
    spec = TableSpec.of(["pk"], ["pk"])
    runs = [sorted(r["pk"] for r in partition_stats(a, b, spec, sampling=0.5, job_id="j").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and 400 < len(runs[0]) < 620
    assert set(range(10)) <= set(runs[0]) and set(range(1000, 1010)) <= set(runs[0])
    for p in (0, -1, 1.5):
        with pytest.raises(ValueError):
            partition_stats(a, b, spec, sampling=p)


def test_repeated_keys_and_positional_plan(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "pk int, c int, v int")
    spec = TableSpec.of(a.columns, ["pk"], ["c"])
    assert repeated_keys(a, spec).count() == 1
    assert partition_stats(a, a, spec, plan="positional").first()["matched_rows"] == 2


def test_columns_named_like_internal_ones(spark):
    a = spark.createDataFrame([(1, 1, 2, 3, 4)], "ck int, side int, v int, in_s int, `a.b` int")
    assert partition_stats(a, a, TableSpec.of(a.columns, ["ck"], ["side"])).first()["status"] == "MATCHED"


def test_statistics():
    one = RangeStats(1, 2, 3, 4, 5, 6, 7, 8, 9)
    assert one + RangeStats() == one and (one + one).mismatched_values == 18
    assert RangeStats().is_empty and RangeStats().all_matches and not one.is_empty and not one.all_matches
    assert RangeStats(mismatched_partitions=1).all_matches and not RangeStats(skipped_partitions=1).all_matches
    assert str(one).startswith("Matched Partitions - 1, Mismatched Partitions - 2, Partition Errors - 3")


def test_fixture_totals(spark):
    from collatio.catalogue import QUERIES

    row = QUERIES["table_stats"](spark, "/root/testdata/sf0.01").first()
    assert (row["matched_partitions"], row["mismatched_partitions"], row["only_in_source"], row["only_in_target"], row["matched_rows"], row["matched_values"], row["mismatched_values"]) == (151, 1260, 89, 79, 13008, 36181, 2843)
    stats = QUERIES["partition_stats_wide"](spark, "/root/testdata/sf0.01")
    assert mismatches(stats).count() == 1260 + 89 + 79
    assert not verdicts(aggregate(stats)).first()["all_matches"]


def test_plan_reads_only_compared_columns_and_no_python(spark):
    from collatio.catalogue import QUERIES

    plan = QUERIES["table_stats"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_sides(spark):
    a = spark.createDataFrame([], "pk int, c int, v int")
    assert aggregate(partition_stats(a, a, TableSpec.of(a.columns, ["pk"], ["c"]))).first()["matched_rows"] == 0
