"""Dataset versions of a session, stored as parquet folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from veritab.sources.readers import DatasetError, read_parquet

VERSIONS = ("original", "processed")


def version_path(root: str, session_id: str, version: str) -> str:
    if version not in VERSIONS:
        raise ValueError(f"unknown version: {version}")
    return f"{root.rstrip('/')}/{session_id}/{version}"


def write_version(df: DataFrame, root: str, session_id: str, version: str = "original") -> str:
    path = version_path(root, session_id, version)
    df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def load_version(spark: SparkSession, root: str, session_id: str, version: str = "processed",
                 fallback: bool = True) -> DataFrame:
    """The asked version; with ``fallback`` the original when there is no processed one."""
    wanted = [version] if not fallback or version == "original" else [version, "original"]
    for name in wanted:
        try:
            return read_parquet(spark, version_path(root, session_id, name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise DatasetError(f"session {session_id} has no dataset ({', '.join(wanted)})")
