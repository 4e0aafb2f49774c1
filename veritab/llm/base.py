"""Registry of the queries of this subpackage, and tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BROADCAST_ROWS = 200_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Tables written in the shared folder the cluster names in ``spark.checkpoint.dir``.

    A written table cuts the lineage: lost executors repeat only what was not yet
    written. ``drop`` deletes a table once what was built from it is written too;
    ``close`` deletes all that are left, for callers that have stored the result.
    """

    _open: list["Scratch"] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        Scratch._open.append(self)

    def path(self) -> str:
        return f"{self.folder}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path, _ = self.paths.pop(id(frame), (None, None))
            if path is not None:
                self._delete(path)

    def close(self) -> None:
        self._delete(self.folder)
        self.paths.clear()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    @classmethod
    def close_all(cls) -> None:
        """Delete the tables of every operator run so far; their results must be stored by then."""
        while cls._open:
            cls._open.pop().close()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; else leave the join to a shuffle, with equal results."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
