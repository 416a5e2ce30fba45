"""Jobs: a configuration's tables compared split by split, in waves, with a journal to resume from.

A wave is a run of splits. All its splits are compared in one pass over both tables, and only when that pass is
through are its statistics, mismatches and errors filed; a job that was stopped goes on with the waves not filed, and
within a split after the last token that was filed for it. Running a job again with tokens to accept reads the splits
that hold them anew and replaces their statistics.

A value that is not of the type a table's configuration asks for (``casts``) is an error of its partition: that is
filed and counted, and the job goes on. A pass that fails as a whole is tried again as the configuration says; then the
side that cannot be read is looked for, its splits are filed as errors, and the job fails.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import Domain, domain_of, token
from ..operators.compare import UNREADABLE, broken_partitions, mismatches, partition_stats, readable, repeated_keys
from ..operators.filters import open_splits
from ..operators.keys import key_columns
from ..operators.schema import common_tables
from ..operators.splits import calculate_splits, check_range, filter_splits, split_of, splits_frame
from ..operators.stats import COUNTERS, RangeStats, by_split
from ..sources.providers import Provider, SideError, load_provider, side_of
from ..spec import ERROR, JobConfig, Modifier, Side, TableName, TableSpec
from .journal import Journal, new_id
from .retry import Strategy, retry, strategy

log = logging.getLogger(__name__)
Results = dict[str, RangeStats]


@dataclass
class DiffJob:
    """A job over two sides. Hooks run before the first table and, after success alone, with the results."""

    spark: SparkSession
    config: JobConfig
    journal: Journal
    before: list[Callable[[JobConfig], None]] = field(default_factory=list)
    after: list[Callable[[JobConfig, Results], None]] = field(default_factory=list)
    source: Provider | None = None
    target: Provider | None = None
    metrics: list[dict] = field(default_factory=list)
    tag: str = field(default_factory=lambda: f"collatio-{new_id()}")

    def __post_init__(self):
        clusters = self.config.cluster_config
        self.source = self.source or load_provider(clusters.get("source", {}), "source")
        self.target = self.target or load_provider(clusters.get("target", {}), "target")

    def stop(self) -> None:
        """Cancels what the job has running, from another thread; its run then fails, and can be resumed."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def tables(self) -> list[TableName]:
        if not self.config.auto_discovery:
            return self.config.tables
        disallowed = self.config.disallowed_keyspaces
        return common_tables(self.source.schema(self.spark, disallowed), self.target.schema(self.spark, disallowed))

    def params(self) -> dict:
        """Those filed under the job's id, if it ran before; else new ones. Splits and tables never change later."""
        job_id = str(self.config.job_id) if self.config.job_id else new_id()
        filed = self.journal.params(job_id) if self.config.job_id else None
        if filed:
            return {"job_id": job_id, "tables": [TableName.parse(t) for t in filed["qualified_table_names"]], "buckets": filed["buckets"], "splits": filed["total_tasks"]}
        return {"job_id": job_id, "tables": self.tables(), "buckets": self.config.buckets, "splits": self.config.splits}

    def run(self) -> Results:
        if domain_of(self.source.partitioner) is not domain_of(self.target.partitioner):
            raise ValueError(f"the sides have different partitioners: {self.source.partitioner} and {self.target.partitioner}")
        self.journal.init()
        made = strategy(self.config.retry_options)
        params = retry(self.params, made)
        job_id = params["job_id"]
        self.journal.start(
            job_id, buckets=params["buckets"], qualified_table_names=[str(t) for t in params["tables"]], source_cluster_name=getattr(self.source, "name", "source"), source_cluster_desc=self.source.description(),
            target_cluster_name=getattr(self.target, "name", "target"), target_cluster_desc=self.target.description(), total_tasks=params["splits"],
        )
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for hook in self.before:
                hook(self.config)
            for table in params["tables"]:
                self._table(table, params)
            rows = retry(lambda: self.journal.finish(job_id).collect(), made)
            results = {r["qualified_table_name"]: RangeStats.of(r) for r in rows}
            for table, stats in sorted(results.items()):
                log.info("%s: %s", table, stats)
            for hook in self.after:
                hook(self.config, results)
            return results
        except Exception as error:
            raise RuntimeError("Diff job failed") from error
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self.journal.stop(job_id)

    def _side(self, side: Side, provider: Provider, table: TableName) -> DataFrame:
        try:
            return provider.table(self.spark, table)
        except Exception as error:
            raise SideError(side.value, error) from error

    def _spec(self, table: TableName, source: DataFrame, target: DataFrame) -> TableSpec:
        shape = self.config.table_specs.get(str(table), {})
        pk = shape.get("partition_key") or [source.columns[0]]
        rest = {k: tuple(shape.get(k) or ()) for k in ("clustering", "descending", "sets")}
        spec = TableSpec.of(source.columns, pk, **rest)
        spec.check_same(TableSpec.of(target.columns, pk, **rest))
        return spec

    def _table(self, table: TableName, params: dict) -> None:
        domain, job_id, name = domain_of(self.source.partitioner), params["job_id"], str(table)
        accept = self.config.specific_tokens
        again = bool(accept.tokens) and accept.modifier is Modifier.ACCEPT
        listed = calculate_splits(params["splits"], params["buckets"], domain)
        for split in listed:
            if split.start != split.end:  # more splits than tokens leave some with one token or none
                check_range(split.start, split.end, domain)
        splits = splits_frame(self.spark, params["splits"], params["buckets"], domain)
        if again:
            splits = splits.where(F.col("split").isin([s.number for s in filter_splits(listed, accept)]))
        todo = open_splits(splits, self.journal.status(job_id, name), include_completed=bool(accept.tokens))
        if accept.tokens:  # read anew: what was counted before does not count again
            todo = todo.withColumns({c: F.lit(0).cast("bigint") for c in COUNTERS})
        rows = sorted(todo.select("split", "resume_after").collect())  # at most as many as the configuration asks for
        if not rows:
            return
        numbers, resumes = [r["split"] for r in rows], any(r["resume_after"] is not None for r in rows)
        made = strategy(self.config.retry_options)
        source = retry(lambda: self._side(Side.SOURCE, self.source, table), made)
        target = retry(lambda: self._side(Side.TARGET, self.target, table), made)
        shape = self.config.table_specs.get(name, {})
        spec = self._spec(table, source, target)
        if casts := shape.get("casts"):
            source, target = readable(source, casts), readable(target, casts)
        plan = shape.get("plan") or ("spread" if repeated_keys(source, spec).union(repeated_keys(target, spec)).isEmpty() else "positional")
        waves = min(self.config.waves, len(numbers))
        size = -(-len(numbers) // waves)
        for at in range(0, len(numbers), size):
            wave = numbers[at : at + size]
            mine = todo.where(F.col("split").between(wave[0], wave[-1]))
            if len(wave) == params["splits"] and not resumes:
                sides = source, target
            else:
                sides = tuple(self._within(side, spec, mine, wave, params["splits"], domain, resumes) for side in (source, target))
            self._wave(table, params, spec, plan, *sides, mine, wave, made)

    @staticmethod
    def _within(side: DataFrame, spec: TableSpec, mine: DataFrame, wave: list[int], n: int, domain: Domain, resumes: bool) -> DataFrame:
        """The rows of a run of splits and, where some were read in part, only those after the last token read."""
        own = token(key_columns(spec), domain)
        inside = side.where(split_of(own, n, domain).between(wave[0], wave[-1]))
        if not resumes:
            return inside
        # as many rows as the wave has splits at most, which the configuration bounds
        done = F.broadcast(mine.where("resume_after is not null").select(F.col("split").alias("__split"), "resume_after"))
        return inside.join(done, (split_of(own, n, domain) == F.col("__split")) & (own <= F.col("resume_after")), "left_anti")

    def _wave(self, table: TableName, params: dict, spec: TableSpec, plan: str, source: DataFrame, target: DataFrame, mine: DataFrame, wave: list[int], made: Strategy) -> None:
        domain, n, job_id = domain_of(self.source.partitioner), params["splits"], params["job_id"]
        began = time.monotonic()
        name = {"job_id": F.lit(job_id), "qualified_table_name": F.lit(str(table))}
        text = lambda c: F.col(c).cast("string").alias(c)

        def compare() -> None:
            stats = partition_stats(
                source, target, spec, plan=plan, domain=domain, tokens=self.config.specific_tokens, sampling=self.config.partition_sampling_probability,
                reverse_probability=self.config.reverse_read_probability, job_id=job_id,
            ).persist()
            seen = Observation()
            try:
                new = by_split(stats, n, domain).drop("highest_token")
                summed = mine.join(new.select(F.col("split").alias("__split"), *[F.col(c).alias(f"__{c}") for c in COUNTERS]), F.col("split") == F.col("__split"), "left")
                zero = F.lit(0).cast("bigint")
                counts = [(F.coalesce(c, zero) + F.coalesce(f"__{c}", zero)).alias(c) for c in COUNTERS]
                status = summed.select("split", "bucket", text("start_token"), text("end_token"), F.col("end_token").cast("string").alias("last_token"), *counts)
                found = mismatches(stats).withColumn("split", split_of(F.col("token"), n, domain)).join(mine.select("split", "bucket"), "split")
                self.journal.append("mismatches", found.select("bucket", F.col("token").cast("string").alias("mismatching_token"), "mismatch_type").withColumns(name))
                if UNREADABLE in source.columns:
                    self._file_errors(stats, source, target, spec, mine, n, domain, name)
                self.journal.append("task_status", status.withColumns(name).observe(seen, *[F.sum(c).alias(c) for c in COUNTERS]))  # last: a wave without it is done again
                self.metrics.append({"table": str(table), "splits": len(wave), "seconds": time.monotonic() - began, **{c: seen.get[c] or 0 for c in COUNTERS}})
                log.info("%s: %d splits in %.1f s", table, len(wave), self.metrics[-1]["seconds"])
            finally:
                stats.unpersist()

        try:
            retry(compare, made)
        except Exception as error:
            blamed = self._blamed(source, target, error)
            try:  # a journal that cannot be written must not hide what went wrong
                bad = mine.select("bucket", text("start_token"), text("end_token")).withColumns(name)
                self.journal.append("task_errors", bad)
                self.journal.append("partition_errors", bad.withColumns({"error_token": F.col("start_token"), "error_source": F.lit(side_of(blamed))}))
            except Exception:  # noqa: BLE001
                log.exception("the errors of %s cannot be filed", table)
            raise blamed from error

    def _file_errors(self, stats: DataFrame, source: DataFrame, target: DataFrame, spec: TableSpec, mine: DataFrame, n: int, domain: Domain, name: dict) -> None:
        """The partitions that could not be read, and the splits that hold them."""
        keys = [f"p{i}" for i in range(len(spec.partition_key))]
        sides = broken_partitions(source, target, spec).select(token([F.col(k) for k in keys], domain).alias("token"), "error_source").distinct()
        failed = stats.where(F.col("status") == ERROR).select("token").join(sides, "token").withColumn("split", split_of(F.col("token"), n, domain))
        text = lambda c: F.col(c).cast("string").alias(c)
        failed = failed.join(mine.select("split", "bucket", "start_token", "end_token"), "split").select("bucket", text("start_token"), text("end_token"), F.col("token").cast("string").alias("error_token"), "error_source").withColumns(name)
        self.journal.append("partition_errors", failed)
        self.journal.append("task_errors", failed.select("bucket", "start_token", "end_token", *name).distinct())

    def _blamed(self, source: DataFrame, target: DataFrame, error: Exception) -> Exception:
        """The error with the side that cannot be read, if either cannot; each is read alone to find out."""
        if side_of(error):
            return error
        for side, table in ((Side.SOURCE, source), (Side.TARGET, target)):
            try:
                table.write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001
                return SideError(side.value, error)
        return error


def main(argv: list[str]) -> Results:
    """python -m collatio.plans.runner CONFIG.yaml JOURNAL_ROOT"""
    spark = SparkSession.builder.appName("collatio").getOrCreate()
    config = JobConfig.load(argv[0])
    try:
        return DiffJob(spark, config, Journal(spark, argv[1], config.metadata_options)).run()
    finally:
        spark.stop()


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
