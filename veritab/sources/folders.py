"""Folders of stored tables, through the file system Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it does not exist. Hidden ones are left out."""
    target, store = _opened(spark, path)
    if not store.exists(target):
        return []
    names = [s.getPath().getName() for s in store.listStatus(target) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> bool:
    """Take a folder out of sight, then delete it; False if there is none.

    It is renamed first, to a name Spark does not read, so that no reader that lists
    the folder from now on sees half of it.
    """
    target, store = _opened(spark, path)
    if not store.exists(target):
        return False
    hidden, _ = _opened(spark, f"{path.rstrip('/').rsplit('/', 1)[0]}/_expired-{uuid.uuid4().hex}")
    if not store.rename(target, hidden):
        raise OSError(f"cannot move {path}")
    return bool(store.delete(hidden, True))
