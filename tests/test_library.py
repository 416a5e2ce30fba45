"""Names, configuration, splits, retries, schemas, providers, journal, jobs and reports."""

import json
import threading
import urllib.request
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from collatio import report
from collatio.functions.tokens import MURMUR3, PORTABLE, RANDOM, domain_of
from collatio.operators.filters import open_splits
from collatio.operators.schema import SYSTEM_KEYSPACES, Schema, common_tables, excluded
from collatio.operators.stats import COUNTERS
from collatio.operators.splits import calculate_splits, check_range, filter_splits, split_of, splits_frame
from collatio.plans.journal import JobConflict, Journal
from collatio.plans.retry import ExponentialRetry, NoRetry, retry, strategy
from collatio.plans.runner import DiffJob
from collatio.sources.providers import FormatProvider, SideError, load_provider, side_of
from collatio.spec import JobConfig, MetadataOptions, Modifier, RetryOptions, SpecificTokens, TableName, TableSpec, quoted


def test_table_names():
    assert TableName.parse(" ks . t ") == TableName("ks", "t") and str(TableName("ks", "t")) == "ks.t"
    for bad in ("t", "a.b.c", ".t", "ks."):
        with pytest.raises(ValueError):
            TableName.parse(bad)
    assert quoted("a`b") == "`a``b`" and quoted("`a`") == "`a`"


def test_specs():
    spec = TableSpec.of(["pk", "c", "v"], ["pk"], ["c"])
    assert spec.regular == ("pk", "v")
    spec.check_same(TableSpec.of(["pk", "c", "v"], ["pk"], ["c"]))
    with pytest.raises(ValueError):
        spec.check_same(TableSpec.of(["pk", "v", "c", "w"], ["pk"], ["c"]))
    with pytest.raises(ValueError):
        TableSpec.of(["pk"], ["no"])


def test_tokens():
    assert SpecificTokens().allows(1)
    accept = SpecificTokens.parse("1, 2", Modifier.ACCEPT)
    assert accept.allows(1) and not accept.allows(3)
    assert not SpecificTokens.parse("1", Modifier.REJECT).allows(1)
    assert SpecificTokens(frozenset(), Modifier.ACCEPT).allows(5)


def test_configuration(tmp_path):
    path = tmp_path / "job.yaml"
    path.write_text("keyspace_tables: [ks1.tb1, ks1.tb2, ks2.tb3]\nsplits: 7\nretry_options: {impl: exponential, base_delay_ms: 1, total_delay_ms: 2}\nspecific_tokens: '1,2'\n")
    config = JobConfig.load(str(path))
    assert len(config.tables) == 3 and config.splits == 7 and config.buckets == 100 and not config.auto_discovery
    assert config.specific_tokens.tokens == {1, 2}
    assert isinstance(strategy(config.retry_options)(), ExponentialRetry)
    assert JobConfig.of({}).auto_discovery
    none = JobConfig.of({"keyspace_tables": ["ks1.a", "ks2.b"], "disallowed_keyspaces": ["ks1", "ks2"]})
    assert not none.tables and not none.auto_discovery
    for bad in ({"specific_tokens": "1", "disallowed_tokens": "2"}, {"partition_sampling_probability": 0}, {"no_such_key": 1}):
        with pytest.raises(ValueError):
            JobConfig.of(bad)


@pytest.mark.parametrize("domain", [MURMUR3, RANDOM, PORTABLE])
@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_splits_tile_the_domain(domain, n):
    splits = calculate_splits(n, 3, domain)
    assert splits[0].start == domain.low and splits[-1].end == domain.high
    assert all(a.end + 1 == b.start for a, b in zip(splits, splits[1:]))
    assert [s.number for s in splits] == list(range(n)) and [s.bucket for s in splits] == [i % 3 for i in range(n)]


@pytest.mark.parametrize("domain", [MURMUR3, PORTABLE])
def test_every_token_is_in_its_split(spark, domain):
    for n in (1, 2, 7, 50):
        splits = calculate_splits(n, 3, domain)
        assert [tuple(r) for r in splits_frame(spark, n, 3, domain).orderBy("split").collect()] == [(s.number, s.bucket, s.start, s.end) for s in splits]
        edges = sorted({t for s in splits for t in (s.start, s.end)})
        got = spark.createDataFrame([(t,) for t in edges], "t bigint").select("t", split_of(F.col("t"), n, domain).alias("s")).collect()
        assert all(splits[r["s"]].start <= r["t"] <= splits[r["s"]].end for r in got)


def test_split_filter_and_ranges():
    splits = calculate_splits(10, 1, PORTABLE)
    tokens = frozenset({0, PORTABLE.high})
    assert [s.number for s in filter_splits(splits, SpecificTokens(tokens, Modifier.ACCEPT))] == [0, 9]
    assert filter_splits(splits, SpecificTokens(tokens, Modifier.REJECT)) == splits
    check_range(0, 1, PORTABLE)
    for low, high in ((None, 1), (0, None), (5, 5), (6, 5), (-1, 5), (0, 2**60)):
        with pytest.raises(ValueError):
            check_range(low, high, PORTABLE)
    assert domain_of("org.example.RandomPartitioner") is RANDOM
    with pytest.raises(ValueError):
        domain_of("ByteOrderedPartitioner")


def test_done_splits_are_left_out(spark):
    splits = spark.createDataFrame([(i, 0, 1, 10) for i in (1, 2, 3)], "split int, bucket int, start_token bigint, end_token bigint")
    status = spark.createDataFrame([(1, 10, 6), (2, 5, None)], "split int, last_token bigint, matched_rows bigint")
    rows = {r["split"]: (r["resume_after"], r["matched_rows"]) for r in open_splits(splits, status).collect()}
    assert rows == {2: (5, 0), 3: (None, 0)}
    assert open_splits(splits, status, include_completed=True).count() == 3


def test_schemas():
    a, b, c = (TableName("ks", f"tbl{i}") for i in (1, 2, 3))
    left, right = Schema([a, b]), Schema([b, c])
    assert left.intersect(right) == right.intersect(left) == Schema([b]) and left.intersect(Schema([a, b])) is left
    assert left.difference(right) == (Schema([a]), Schema([c]))
    assert common_tables(left, right) == [b]
    assert "system" in excluded() and excluded(["x"]) == SYSTEM_KEYSPACES | {"x"}


def test_backoff():
    own = ExponentialRetry(10, 1000)
    pauses = [own.pause_ms() for _ in range(100)]
    taken = [p for p in pauses if p >= 0]
    assert taken[:6] == [10, 20, 40, 80, 160, 320] and sum(taken) == 1000 and set(pauses[len(taken):]) == {-1}
    with pytest.raises(ValueError):
        ExponentialRetry(2, 1)
    big = ExponentialRetry(1, 2**62)
    assert all(big.pause_ms() >= 0 for _ in range(62))


def test_retries():
    calls = []

    def fail():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        retry(fail, strategy(RetryOptions(base_delay_ms=1, total_delay_ms=2)), sleep=lambda s: None)
    assert len(calls) == 3
    with pytest.raises(OSError):
        retry(fail, strategy(RetryOptions(base_delay_ms=1, total_delay_ms=2)), (OSError,), sleep=lambda s: None)
    assert len(calls) == 4
    assert strategy(None) is NoRetry and strategy(RetryOptions(impl="no.such.Thing")) is NoRetry and NoRetry().pause_ms() == -1


def test_sides_of_errors(monkeypatch):
    error = RuntimeError("outer")
    error.__cause__ = SideError("SOURCE", OSError("x"))
    assert side_of(error) == "SOURCE" and side_of(OSError()) == ""
    monkeypatch.setenv("COLLATIO_SOURCE_USER", "me")
    provider = load_provider({"name": "a", "dc": "dc1"}, "source")
    assert isinstance(provider, FormatProvider) and provider.options["user"] == "me" and "dc1" in provider.description()


@pytest.fixture
def sides(spark, tmp_path):
    a = spark.range(200).select(F.col("id").alias("pk"), (F.col("id") * 2).alias("v"))
    b = a.where("pk % 10 <> 3").select("pk", F.when(F.col("pk") % 20 == 0, -1).otherwise(F.col("v")).alias("v"))
    for name, frame in (("a", a), ("b", b)):
        frame.write.parquet(str(tmp_path / name / "ks" / "t"))
        frame.limit(50).write.parquet(str(tmp_path / name / "ks" / "u"))
    return tmp_path


def config(sides, **more):
    sources = {k: {"path": f"{sides}/{d}/{{keyspace}}/{{table}}", "tables": ["ks.t", "ks.u"], "name": k} for k, d in (("source", "a"), ("target", "b"))}
    return JobConfig.of({"splits": 10, "buckets": 3, "cluster_config": sources, "keyspace_tables": ["ks.t"], **more})


@pytest.mark.parametrize("waves", [1, 3])
def test_a_job_from_end_to_end(spark, sides, waves):
    journal = Journal(spark, f"{sides}/journal{waves}", MetadataOptions(should_init=True))
    job_id, seen = str(uuid.uuid4()), []
    job = DiffJob(spark, config(sides, job_id=job_id, waves=waves), journal, before=[seen.append], after=[lambda c, r: seen.append(r)])
    stats = job.run()["ks.t"]
    assert (stats.matched_partitions, stats.mismatched_partitions, stats.only_in_source, stats.matched_rows) == (170, 10, 20, 180)
    assert len(seen) == 2 and journal.read("running_jobs").count() == 0
    assert len(job.metrics) == waves and sum(m["splits"] for m in job.metrics) == 10
    read = journal.read
    assert read("mismatches").count() == 30 and {r["completed"] for r in report.completed(read("task_status"), job_id).collect()} == {10}
    again = DiffJob(spark, config(sides, job_id=job_id, splits=77), journal).run()["ks.t"]  # nothing left; the filed splits hold
    assert again == stats
    assert report.results(read("job_summary"), read("job_results"), job_id).first()["matched_partitions"] == 170
    service = report.Report(journal)
    status, body = service.answer(f"/jobs/{job_id}/results")
    assert status == 200 and json.loads(body)[0]["only_in_source"] == 20
    assert service.answer("/jobs/none")[0] == 404 and service.answer("/jobs/by-start-date/x")[0] == 400 and service.answer("/x")[0] == 404
    for path in ("running", "running/id", "recent", "by-keyspace/ks", "by-source-cluster/source", "by-target-cluster/target", "by-start-date/2020-01-01", "by-start-date/2020-01-01/2099-01-01", job_id, f"{job_id}/status", f"{job_id}/mismatches", f"{job_id}/errors", f"{job_id}/errors/ranges", f"{job_id}/errors/summary"):
        assert service.answer(f"/jobs/{path}")[0] == 200, path
    server = service.serve(0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/__health") as answer:
        assert answer.read() == b"All is good."
    server.shutdown()
    service.healthy = False
    assert service.health()[0] == 500
    assert read("job_status").agg(F.sum("completed")).first()[0] == 10 and read("keyspace_index").first()["keyspace_name"] == "ks"
    for name in ("source_cluster_index", "target_cluster_index", "job_start_index"):
        assert read(name).count() == 1


def test_rerun_with_tokens_replaces(spark, sides):
    journal, job_id = Journal(spark, f"{sides}/journal", MetadataOptions()), str(uuid.uuid4())
    first = DiffJob(spark, config(sides, job_id=job_id), journal).run()["ks.t"]
    token = journal.read("mismatches").first()["mismatching_token"]
    second = DiffJob(spark, config(sides, job_id=job_id, specific_tokens=token), journal).run()["ks.t"]
    assert second.skipped_partitions > 0 and second.only_in_source == first.only_in_source
    assert sum((second.matched_partitions, second.mismatched_partitions, second.skipped_partitions)) == 180


def test_discovery_conflict_and_failure(spark, sides):
    journal = Journal(spark, f"{sides}/journal", MetadataOptions())
    assert set(DiffJob(spark, config(sides, keyspace_tables=None), journal).run()) == {"ks.t", "ks.u"}
    journal.start("j", buckets=1, qualified_table_names=[], source_cluster_name="", source_cluster_desc="", target_cluster_name="", target_cluster_desc="", total_tasks=1)
    with pytest.raises(JobConflict):
        journal.start("j")
    journal.stop("j")
    bad = config(sides, keyspace_tables=["ks.none"], job_id=str(uuid.uuid4()))
    with pytest.raises(RuntimeError, match="Diff job failed") as error:
        DiffJob(spark, bad, journal).run()
    assert side_of(error.value) == "SOURCE" and journal.read("running_jobs").count() == 0


class Broken(FormatProvider):
    """A side whose rows cannot be read."""

    def table(self, spark, name):
        frame = super().table(spark, name)
        return frame.withColumn("v", F.expr("CASE WHEN pk = 7 THEN raise_error('broken row') ELSE v END").cast("bigint"))


def test_errors_are_filed_and_the_job_can_go_on(spark, sides):
    journal, job_id = Journal(spark, f"{sides}/journal", MetadataOptions()), str(uuid.uuid4())
    good = config(sides, job_id=job_id, waves=2)
    sources = {**good.cluster_config, "source": {**good.cluster_config["source"], "impl": f"{__name__}.Broken"}}
    with pytest.raises(RuntimeError, match="Diff job failed"):
        DiffJob(spark, config(sides, job_id=job_id, waves=2, cluster_config=sources), journal).run()
    errors = report.error_summary(journal.read("task_errors"), job_id).first()
    assert {r["error_source"] for r in journal.read("partition_errors").collect()} == {"SOURCE"}
    assert errors["errors"] == 5 and len(report.error_tokens(journal.read("task_errors"), journal.read("partition_errors"), job_id).first()["tokens"]) == 5
    assert DiffJob(spark, good, journal).run()["ks.t"].matched_partitions == 170


def test_broken_values_are_errors_of_their_partitions(spark, sides):
    for name in "ab":
        rows = spark.read.parquet(f"{sides}/{name}/ks/t").withColumn("v", F.when(F.col("pk") == (8 if name == "a" else 11), "n/a").otherwise(F.col("v").cast("string")))
        rows.write.parquet(f"{sides}/{name}/ks/broken")
    journal, job_id = Journal(spark, f"{sides}/journal", MetadataOptions()), str(uuid.uuid4())
    own = config(sides, job_id=job_id, keyspace_tables=["ks.broken"], table_specs={"ks.broken": {"partition_key": ["pk"], "casts": {"v": "bigint"}, "plan": "spread"}}, waves=2)
    job = DiffJob(spark, own, journal)
    stats = job.run()["ks.broken"]
    assert (stats.error_partitions, stats.matched_partitions, stats.mismatched_partitions, stats.only_in_source) == (2, 168, 10, 20)
    assert sum(m["error_partitions"] for m in job.metrics) == 2
    errors = journal.read("partition_errors", job_id).collect()
    expected = {r["t"]: s for k, s in ((8, "SOURCE"), (11, "TARGET")) for r in spark.range(k, k + 1).select(F.xxhash64("id").cast("string").alias("t")).collect()}
    assert {r["error_token"]: r["error_source"] for r in errors} == expected
    assert report.error_tokens(journal.read("task_errors"), journal.read("partition_errors"), job_id).first()["tokens"] == sorted(expected)


def test_a_split_goes_on_after_its_last_token(spark, sides):
    journal, job_id = Journal(spark, f"{sides}/journal", MetadataOptions()), str(uuid.uuid4())
    whole = DiffJob(spark, config(sides, job_id=str(uuid.uuid4())), Journal(spark, f"{sides}/other", MetadataOptions())).run()["ks.t"]
    job = DiffJob(spark, config(sides, job_id=job_id), journal)
    params = job.params()
    journal.append("job_summary", [{"job_id": job_id, "buckets": 3, "qualified_table_names": ["ks.t"], "total_tasks": 10}])
    split = calculate_splits(10, 3)[4]
    tokens = sorted(r["t"] for r in spark.range(200).select(F.xxhash64("id").alias("t")).collect() if split.start <= r["t"] <= split.end)
    part = {"job_id": job_id, "bucket": split.bucket, "qualified_table_name": "ks.t", "split": 4, "start_token": str(split.start), "end_token": str(split.end), "last_token": str(tokens[2])}
    journal.append("task_status", [part | {c: 1000 if c == "matched_partitions" else 0 for c in COUNTERS}])
    stats = job.run()["ks.t"]
    read = {r["pk"]: r["t"] for r in spark.range(200).select(F.col("id").alias("pk"), F.xxhash64("id").alias("t")).collect() if r["t"] in tokens[:3]}
    matched = sum(pk % 10 != 3 and pk % 20 != 0 for pk in read)
    assert params["splits"] == 10 and stats.matched_partitions == whole.matched_partitions - matched + 1000


def test_a_job_that_was_killed_goes_on_with_the_next_wave(spark, sides, monkeypatch):
    journal, job_id = Journal(spark, f"{sides}/journal", MetadataOptions()), str(uuid.uuid4())
    wave, done = DiffJob._wave, []

    def killed(self, *args):
        if len(done) == 2:
            raise KeyboardInterrupt
        wave(self, *args)
        done.append(args[-2])

    monkeypatch.setattr(DiffJob, "_wave", killed)
    with pytest.raises(KeyboardInterrupt):
        DiffJob(spark, config(sides, job_id=job_id, waves=5), journal).run()
    assert done == [[0, 1], [2, 3]] and journal.status(job_id, "ks.t").count() == 4
    done.clear()
    monkeypatch.setattr(DiffJob, "_wave", lambda self, *args: (done.append(args[-2]), wave(self, *args)))
    stats = DiffJob(spark, config(sides, job_id=job_id, waves=3), journal).run()["ks.t"]
    assert done == [[4, 5], [6, 7], [8, 9]] and stats.matched_partitions == 170


def test_a_pass_that_fails_is_tried_again(spark, sides, monkeypatch):
    from collatio.plans import runner

    journal, tries = Journal(spark, f"{sides}/journal", MetadataOptions()), []
    compare = runner.partition_stats

    def once(*args, **kw):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("connection reset")
        return compare(*args, **kw)

    monkeypatch.setattr(runner, "partition_stats", once)
    stats = DiffJob(spark, config(sides, retry_options={"impl": "exponential", "base_delay_ms": 1, "total_delay_ms": 2}), journal).run()["ks.t"]
    assert len(tries) == 2 and stats.matched_partitions == 170


def test_recent_jobs_widen(spark):
    days = [1, 2, 40, 41, 42, 43, 44, 45, 46, 47, 70, 200]
    rows = spark.createDataFrame([(f"j{d}", d) for d in days], "job_id string, d int").select("job_id", F.expr("cast(date_sub(date'2024-12-31', d) as timestamp)").alias("job_start_time"))
    assert report.recent_jobs(rows, date(2024, 12, 31)).count() == 10
    assert report.recent_jobs(rows.where("d <> 47"), date(2024, 12, 31)).count() == 10  # to 90 days
    with pytest.raises(ValueError):
        report.jobs_between(rows, date(2024, 1, 2), date(2024, 1, 1))
    assert report.jobs_between(rows, date(2024, 12, 1)).count() == 2
