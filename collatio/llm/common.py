"""What the text operators share: sessions, shared folders, hashing, reading of tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import remove

#: Rows of one Arrow batch: texts can be long, so a batch of the default 10,000 rows could be gigabytes.
BATCH_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session already asks for less than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and everything runs on one machine a temporary folder is made and set; on a cluster that
    is an error, as its executors could not read each other's files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="collatio-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/collatio/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; the folder is scratch space
        remove(spark, path)


def all_cores(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """A table too small for all cores (fewer than ``least_bytes`` for each) dealt evenly to them; any other as it is.

    Files of one row group are read by one task, and what follows in Python would run there alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * least_bytes else df


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written meanwhile has its shuffle files deleted when it is written, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """In a Python worker: returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker keeps from task to task, by the operator that made it.
KEPT: dict[str, dict] = {}


def make_room(owner: str) -> None:
    for name, kept in KEPT.items():
        if name != owner:
            kept.clear()


def lean(run, owner: str = ""):
    """run (batches to batches, in a Python worker) so that a worker, which lives on, holds little between tasks.

    What operators other than ``owner`` keep goes before the first batch, memory that the task has freed after the last."""

    @functools.wraps(run)
    def task(batches):
        make_room(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


class Scratch:
    """Intermediate tables of one run of an operator, dropped together when its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.number = spark, shared_path(spark, name), 0

    def stored(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        if release:
            self.release()
        self.number += 1
        path = f"{self.root}/{self.number}-{name}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffles of tables that are stored by now; else they stay until the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        _remove(self.spark, self.root)
        self.release()


def held_out(key: Column, modulus: int, remainder: int = 2) -> Column:
    """True for the rows kept from learning: crc32 of the key as text leaves the remainder; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, a null text as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def sample_rate(rows: int, wanted: int) -> float:
    return 1.0 if rows <= wanted else wanted / rows


def hash_below(key: Column, rate: float | Column) -> Column:
    """A repeatable sample by the hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(1 << 30) * rate


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit keys (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
