"""Files that the driver itself makes, lists and removes, in any store that Spark and pyarrow both know."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is in the session's default store, as for Spark."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        path = root.rstrip("/") + path if not root.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def exists(spark: SparkSession, path: str) -> bool:
    store, inner = located(spark, path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def make_folder(spark: SparkSession, path: str) -> None:
    store, inner = located(spark, path)
    store.create_dir(inner, recursive=True)


def remove(spark: SparkSession, path: str) -> None:
    """A file or a folder with all it holds; nothing happens where there is none."""
    store, inner = located(spark, path)
    kind = store.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        store.delete_dir(inner)
    elif kind == fs.FileType.File:
        store.delete_file(inner)


def take(spark: SparkSession, folder: str, name: str) -> bool:
    """Leaves a mark of that name in a folder and says whether it is the only one; of two callers at most one is told so,
    and of two at the same moment both may be refused."""
    store, inner = located(spark, folder)
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/{name}") as out:
        out.write(b"")
    marks = [i.base_name for i in store.get_file_info(fs.FileSelector(inner)) if not i.base_name.startswith(".")]
    if marks == [name]:
        return True
    store.delete_file(f"{inner}/{name}")
    return False
