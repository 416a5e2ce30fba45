"""The journal of jobs: twelve tables of Parquet files that are only ever added to.

Files lie in folders by job and, where the table has one, by bucket, so that what concerns one job reads its files alone.
A row that is written again under the same key replaces the earlier one when the table is read (the latest write wins),
and rows older than the time to live are not read. Counters of finished splits and the lookups by cluster, keyspace and
start time are derived from the other tables rather than kept beside them.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import COUNTERS, accumulate
from ..spec import MetadataOptions
from .store import exists, make_folder, remove, take

log = logging.getLogger(__name__)
_COUNTS = ", ".join(f"{c} bigint" for c in COUNTERS)

#: Columns of each table and, before the bar, its key. Tokens are text, as they can be wider than 64 bits.
TABLES = {
    "task_status": ("job_id, bucket, qualified_table_name, start_token, end_token", f"job_id string, bucket int, qualified_table_name string, split int, start_token string, end_token string, last_token string, {_COUNTS}"),
    "job_summary": ("job_id", "job_id string, job_start_time timestamp, buckets int, qualified_table_names array<string>, source_cluster_name string, source_cluster_desc string, target_cluster_name string, target_cluster_desc string, total_tasks int"),
    "job_results": ("job_id, qualified_table_name", f"job_id string, qualified_table_name string, {_COUNTS}"),
    "mismatches": ("job_id, bucket, qualified_table_name, mismatching_token, mismatch_type", "job_id string, bucket int, qualified_table_name string, mismatching_token string, mismatch_type string"),
    "task_errors": ("job_id, bucket, qualified_table_name, start_token, end_token", "job_id string, bucket int, qualified_table_name string, start_token string, end_token string"),
    "partition_errors": ("job_id, bucket, qualified_table_name, start_token, end_token, error_token", "job_id string, bucket int, qualified_table_name string, start_token string, end_token string, error_token string, error_source string"),
    "running_jobs": ("job_id", "job_id string, running boolean"),
}
#: Read-only tables, derived from those above.
DERIVED = ("job_status", "source_cluster_index", "target_cluster_index", "keyspace_index", "job_start_index")


def latest_rows(rows: DataFrame, key: Iterable[str], oldest: int | None = None) -> DataFrame:
    """The row of each key that was written last, without those written before ``oldest``."""
    if oldest is not None:
        rows = rows.where(F.col("written_at") >= oldest)
    ties = F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")])  # rows of one append: a fixed one of them
    order = Window.partitionBy(*key).orderBy(F.desc("written_at"), ties)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "written_at")


class JobConflict(RuntimeError):
    pass


class Journal:
    def __init__(self, spark: SparkSession, root: str, options: MetadataOptions | None = None):
        self.spark, self.options = spark, options or MetadataOptions()
        self.root = f"{root.rstrip('/')}/{self.options.keyspace}"

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def init(self) -> None:
        """Makes the tables' folders, if the options ask for it; doing so again changes nothing."""
        if self.options.should_init:
            for table in TABLES:
                make_folder(self.spark, self._path(table))

    def append(self, table: str, rows: DataFrame | Iterable[dict[str, Any]]) -> None:
        schema = TABLES[table][1]
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(list(rows), schema)
        names = [f.name for f in self.spark.createDataFrame([], schema).schema.fields]
        rows = rows.select(*names, F.lit(time.time_ns()).alias("written_at"))
        folders = [c for c in ("job_id", "bucket") if c in names]
        if "bucket" in names:
            rows = rows.repartition("bucket")  # one file for each bucket, not one for each task and bucket
        rows.write.mode("append").partitionBy(*folders).parquet(self._path(table))

    def _all(self, table: str, job_id: str | None = None) -> DataFrame:
        schema = f"{TABLES[table][1]}, written_at bigint"
        if not exists(self.spark, self._path(table)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._path(table))
        return rows if job_id is None else rows.where(F.col("job_id") == job_id)

    def read(self, table: str, job_id: str | None = None) -> DataFrame:
        """The latest row of each key that is not past its time to live; with ``job_id`` of that job alone."""
        if table in DERIVED:
            return getattr(self, table)()
        key = TABLES[table][0].split(", ")
        oldest = time.time_ns() - self.options.ttl_seconds * 1_000_000_000
        out = latest_rows(self._all(table, job_id), key, oldest)
        return out.where("running").select("job_id") if table == "running_jobs" else out

    def job_status(self) -> DataFrame:
        """(job_id, bucket, qualified_table_name, completed): splits that were read to their end."""
        done = self.read("task_status").where(F.col("last_token") == F.col("end_token"))
        return done.groupBy("job_id", "bucket", "qualified_table_name").agg(F.count(F.lit(1)).alias("completed"))

    def source_cluster_index(self) -> DataFrame:
        return self.read("job_summary").select("source_cluster_name", "job_id")

    def target_cluster_index(self) -> DataFrame:
        return self.read("job_summary").select("target_cluster_name", "job_id")

    def keyspace_index(self) -> DataFrame:
        """By the keyspaces that are compared."""
        return self.read("job_summary").select(F.explode("qualified_table_names").alias("t"), "job_id").select(F.substring_index("t", ".", 1).alias("keyspace_name"), "job_id").distinct()

    def job_start_index(self) -> DataFrame:
        start = F.col("job_start_time")
        return self.read("job_summary").select(F.to_date(start).alias("job_start_date"), F.hour(start).alias("job_start_hour"), start.alias("job_start_time"), "job_id")

    # the life of a job

    def params(self, job_id: str) -> dict[str, Any] | None:
        row = self.read("job_summary", job_id).first()
        return row.asDict() if row else None

    def start(self, job_id: str, **summary: Any) -> None:
        """Marks a job as running, which only one run at a time can, and files its summary if it is new."""
        lock = f"{self.root}/locks/{job_id}"
        if not take(self.spark, lock, new_id()):
            raise JobConflict(f"job {job_id} is running already, or ended without a trace; remove {lock} in that case")
        self.append("running_jobs", [{"job_id": job_id, "running": True}])
        if self.params(job_id) is None:
            start = datetime.now(timezone.utc).replace(tzinfo=None)
            self.append("job_summary", [{"job_id": job_id, "job_start_time": start, **summary}])

    def stop(self, job_id: str) -> None:
        """Marks a job as not running; a failure to do so is logged alone."""
        try:
            self.append("running_jobs", [{"job_id": job_id, "running": False}])
            remove(self.spark, f"{self.root}/locks/{job_id}")
        except Exception:  # noqa: BLE001
            log.exception("job %s cannot be marked as ended", job_id)

    def status(self, job_id: str, table: str) -> DataFrame:
        """(split, last_token, counters) of a table's splits, as far as they were read."""
        rows = self.read("task_status", job_id).where(F.col("qualified_table_name") == table)
        return rows.select("split", F.col("last_token").cast("bigint").alias("last_token"), *COUNTERS)

    def finish(self, job_id: str) -> DataFrame:
        """Sums all splits of a job, whichever run read them, and files the results by table."""
        rows = self.read("task_status", job_id)
        results = accumulate(rows, ["job_id", "qualified_table_name"])
        self.append("job_results", results)
        return self.read("job_results", job_id)


def new_id() -> str:
    return str(uuid.uuid4())
