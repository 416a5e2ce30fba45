"""Queries on the journal, as DataFrames, and a small read-only HTTP service over them.

Every function takes the journal's tables as DataFrames and returns one, so they run on any copy of a journal.
"""

from __future__ import annotations

from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.stats import COUNTERS
from .plans.journal import Journal

ENOUGH, STEP_DAYS, MOST_DAYS = 10, 30, 90


def running_ids(running: DataFrame) -> DataFrame:
    return running.select("job_id")


def running_jobs(summary: DataFrame, running: DataFrame) -> DataFrame:
    """Oldest first."""
    return summary.join(running.select("job_id"), "job_id", "left_semi").orderBy("job_start_time", "job_id")


def newest_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("job_start_time"), "job_id")


def recent_jobs(summary: DataFrame, today: date) -> DataFrame:
    """Jobs of the last 30 days; while they are fewer than ten, 30 days more, to 90 at most. All jobs of that time are
    kept, in one pass: each job knows how many are as recent as its own step."""
    age = F.floor(F.datediff(F.lit(today), F.to_date("job_start_time")) / STEP_DAYS)
    steps = MOST_DAYS // STEP_DAYS
    aged = summary.where(F.to_date("job_start_time") <= F.lit(today)).withColumn("__step", F.greatest(age, F.lit(0))).where(F.col("__step") < steps)
    counts = [F.count_if(F.col("__step") <= i).alias(f"n{i}") for i in range(steps)]
    needed = F.lit(steps - 1)
    for i in reversed(range(steps)):
        needed = F.when(F.col(f"n{i}") >= ENOUGH, i).otherwise(needed)
    limit = aged.agg(*counts).select(needed.alias("__limit"))  # one row
    return newest_first(aged.join(F.broadcast(limit), F.col("__step") <= F.col("__limit")).drop("__step", "__limit"))


def job(summary: DataFrame, job_id: str) -> DataFrame:
    out = summary.where(F.col("job_id") == job_id)
    if out.isEmpty():
        raise LookupError(f"Job {job_id} not found")
    return out


def results(summary: DataFrame, results_: DataFrame, job_id: str) -> DataFrame:
    """Of the tables that the job's summary names, by table."""
    tables = summary.where(F.col("job_id") == job_id).select("job_id", F.explode("qualified_table_names").alias("qualified_table_name"))
    return results_.join(tables, ["job_id", "qualified_table_name"], "left_semi").select("qualified_table_name", *COUNTERS).orderBy("qualified_table_name")


def completed(task_status: DataFrame, job_id: str) -> DataFrame:
    """Splits read to their end, by table."""
    done = task_status.where((F.col("job_id") == job_id) & (F.col("last_token") == F.col("end_token")))
    return done.groupBy("qualified_table_name").agg(F.count(F.lit(1)).alias("completed"))


def mismatches(found: DataFrame, job_id: str) -> DataFrame:
    """Per table a sorted list of (token, type)."""
    entry = F.struct(F.col("mismatching_token").alias("token"), F.col("mismatch_type").alias("type"))
    return found.where(F.col("job_id") == job_id).groupBy("qualified_table_name").agg(F.array_sort(F.collect_list(entry)).alias("mismatches"))


def error_summary(errors: DataFrame, job_id: str) -> DataFrame:
    """Splits in error, by table."""
    return errors.where(F.col("job_id") == job_id).groupBy("qualified_table_name").agg(F.count(F.lit(1)).alias("errors"))


def error_ranges(errors: DataFrame, job_id: str) -> DataFrame:
    entry = F.struct(F.col("start_token").alias("start"), F.col("end_token").alias("end"))
    return errors.where(F.col("job_id") == job_id).groupBy("qualified_table_name").agg(F.array_sort(F.collect_list(entry)).alias("ranges"))


def error_tokens(errors: DataFrame, details: DataFrame, job_id: str) -> DataFrame:
    on = ["job_id", "bucket", "qualified_table_name", "start_token", "end_token"]
    found = errors.where(F.col("job_id") == job_id).join(details, on)
    return found.groupBy("qualified_table_name").agg(F.array_sort(F.collect_list("error_token")).alias("tokens"))


def jobs_between(summary: DataFrame, after: date, before: date | None = None) -> DataFrame:
    """Jobs started from the first day to the last, both whole; without a last day to the end."""
    if before is not None and before < after:
        raise ValueError("the last day is before the first")
    day = F.to_date("job_start_time")
    inside = day >= F.lit(after)
    return newest_first(summary.where(inside if before is None else inside & (day <= F.lit(before))))


def by_source(summary: DataFrame, cluster: str) -> DataFrame:
    return newest_first(summary.where(F.col("source_cluster_name") == cluster))


def by_target(summary: DataFrame, cluster: str) -> DataFrame:
    return newest_first(summary.where(F.col("target_cluster_name") == cluster))


def by_keyspace(summary: DataFrame, keyspace: str) -> DataFrame:
    """Jobs that compare any table of a keyspace."""
    return newest_first(summary.where(F.exists("qualified_table_names", lambda t: F.substring_index(t, ".", 1) == keyspace)))


class Report:
    """The queries on one journal, answered as JSON by path."""

    def __init__(self, journal: Journal):
        self.journal, self.healthy = journal, None

    def health(self) -> tuple[int, str]:
        if self.healthy is not None:
            return (200, "All is good.") if self.healthy else (500, "Not healthy")
        try:
            self.journal.read("running_jobs").limit(1).collect()
            return 200, "All is good."
        except Exception as error:  # noqa: BLE001
            return 500, str(error)

    def answer(self, path: str) -> tuple[int, str]:
        """Status and body for a path such as /jobs/recent or /jobs/ID/results."""
        parts = [p for p in path.split("/") if p]
        if parts == ["__health"]:
            return self.health()
        try:
            frame = self._frame(parts)
        except LookupError as error:
            return 404, str(error)
        except ValueError as error:
            return 400, str(error)
        if frame is None:
            return 404, f"no such query: {path}"
        return 200, "[" + ",".join(r[0] for r in frame.select(F.to_json(F.struct("*"))).collect()) + "]"

    def _frame(self, parts: list[str]) -> DataFrame | None:
        read = self.journal.read
        match parts:
            case ["jobs", "running", "id"]:
                return running_ids(read("running_jobs"))
            case ["jobs", "running"]:
                return running_jobs(read("job_summary"), read("running_jobs"))
            case ["jobs", "recent"]:
                return recent_jobs(read("job_summary"), date.today())
            case ["jobs", "by-start-date", after]:
                return jobs_between(read("job_summary"), date.fromisoformat(after))
            case ["jobs", "by-start-date", after, before]:
                return jobs_between(read("job_summary"), date.fromisoformat(after), date.fromisoformat(before))
            case ["jobs", "by-source-cluster", name]:
                return by_source(read("job_summary"), name)
            case ["jobs", "by-target-cluster", name]:
                return by_target(read("job_summary"), name)
            case ["jobs", "by-keyspace", name]:
                return by_keyspace(read("job_summary"), name)
            case ["jobs", id_]:
                return job(read("job_summary"), id_)
            case ["jobs", id_, "results"]:
                return results(read("job_summary"), read("job_results"), id_)
            case ["jobs", id_, "status"]:
                return completed(read("task_status"), id_)
            case ["jobs", id_, "mismatches"]:
                return mismatches(read("mismatches"), id_)
            case ["jobs", id_, "errors", "summary"]:
                return error_summary(read("task_errors"), id_)
            case ["jobs", id_, "errors", "ranges"]:
                return error_ranges(read("task_errors"), id_)
            case ["jobs", id_, "errors"]:
                return error_tokens(read("task_errors"), read("partition_errors"), id_)
        return None

    def serve(self, port: int = 8089) -> ThreadingHTTPServer:
        """A server, not yet started: call serve_forever() on it."""
        report = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                status, body = report.answer(self.path)
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json" if body.startswith("[") else "text/plain")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)
