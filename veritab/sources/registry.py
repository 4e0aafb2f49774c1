"""Append-only metadata tables and the lookups over them.

Every lookup takes a whole log table and answers for all sessions at once;
filter the result, or the input, for one session.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.functions.ranking import lookup
from veritab.schema import col
from veritab.sources import folders

LOG_SCHEMA = (
    "session_id string, timestamp timestamp, operation_type string, model_type string, operation_id string, "
    "action string, status string, error string, duration_ms bigint, rows_before bigint, rows_after bigint, "
    "columns_before bigint, columns_after bigint, parameters map<string,string>, details string, ttl bigint"
)
SESSION_SCHEMA = (
    "session_id string, updated_at timestamp, file_name string, original_path string, processed_path string, "
    "quality_score double, row_count bigint, column_count bigint"
)
DECISION_RETENTION = timedelta(days=30)
DATASET_RETENTION = timedelta(days=30)
EXPIRY_DAY = "expiry_day"
CACHE_LIFETIME_HOURS = 24


def _as_text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str)


def _moment(value: Any) -> Any:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def log_frame(spark: SparkSession, entries: Iterable[dict[str, Any]]) -> DataFrame:
    """Log records; fields without a column of their own go to ``details`` as JSON."""
    names = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
    rows = []
    for entry in entries:
        rest = {k: v for k, v in entry.items() if k not in names}
        parameters = entry.get("parameters") or {}
        if isinstance(parameters, str):
            parameters = json.loads(parameters)
        details = {**rest, **(entry.get("details") or {})}
        rows.append(tuple(
            {k: _as_text(v) for k, v in parameters.items()} if n == "parameters"
            else (_as_text(details) if details else None) if n == "details"
            else _moment(entry.get(n)) if n == "timestamp" else entry.get(n)
            for n in names
        ))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("operation_type").parquet(path)


def latest_per_key(df: DataFrame, keys: Sequence[str], moment: str, tie: str | None = None) -> DataFrame:
    """The newest row per key. The partial aggregate keeps one row per key and task."""
    order = F.struct(*[col(c) for c in (moment, tie) if c])
    fields = F.struct(*[col(c) for c in df.columns])
    return (
        df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.max_by(fields, order).alias("_row")).select("_row.*")
    )


def newest_rows(log: DataFrame, key: str, moment: str, n: int, tie: str | None = None) -> DataFrame:
    """The newest ``n`` rows per key; tasks cut their own rows to ``n`` before the shuffle."""
    order = [col(moment).desc(), *([col(tie).desc()] if tie else [])]
    return (
        log.withColumn("_rank", F.row_number().over(Window.partitionBy(col(key)).orderBy(*order)))
        .filter(F.col("_rank") <= n).drop("_rank")
    )


def latest_operation(log: DataFrame, moment: str = "timestamp", session: str = "session_id",
                     kinds: Sequence[str] = ("operation_type", "model_type"), tie: str | None = None) -> DataFrame:
    """The newest row per session and operation type, whatever was logged after it."""
    return latest_per_key(log, [session, *kinds], moment, tie)


def operation_status(log: DataFrame) -> DataFrame:
    """State of each asynchronous operation: its results once completed, its error once failed."""
    state = latest_per_key(log, ["session_id", "operation_id"], "timestamp")
    return state.select(
        "session_id", "operation_id", "status",
        F.when(F.col("status") == "completed", F.col("details")).alias("results"),
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
    )


def upsert_session(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def session_frame(spark: SparkSession, records: Iterable[dict[str, Any]]) -> DataFrame:
    names = [part.split()[0] for part in SESSION_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], SESSION_SCHEMA)


def current_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session: each field's newest non-NULL value, and the dataset to read."""
    fields = [c for c in sessions.columns if c not in ("session_id", "updated_at")]
    newest = sessions.groupBy("session_id").agg(
        F.max("updated_at").alias("updated_at"),
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col("updated_at"))).alias(c) for c in fields])
    return newest.withColumn("dataset_path", F.coalesce("processed_path", "original_path"))


def cache_probe(requests: DataFrame, cache: DataFrame, hash_column: str, stored: str, now: Column,
                hours: int = CACHE_LIFETIME_HOURS) -> DataFrame:
    """Each request with its newest cached entry no older than ``hours``; ``hit`` tells if there is one.

    Entries are cut to one per hash before the join, and hashes that very many
    requests share are joined apart.
    """
    fresh = cache.filter(col(stored) >= now - F.make_interval(hours=F.lit(hours)))
    entries = fresh.groupBy(col(hash_column)).agg(F.max_by(
        F.struct(*[col(c) for c in cache.columns if c != hash_column]), col(stored)).alias("cached"))
    asked = requests.groupBy(col(hash_column)).agg(F.count(F.lit(1)).alias("_asked"))
    table = entries.join(asked, hash_column).withColumnRenamed(hash_column, "_hash")
    return lookup(requests, hash_column, table, "_hash", "_asked").withColumn("hit", F.col("cached").isNotNull())


def cache_misses(probed: DataFrame) -> DataFrame:
    return probed.filter(~F.col("hit")).drop("cached", "hit")


def unexpired(df: DataFrame, ttl: Column, now: Column) -> DataFrame:
    """Rows whose time to live lies after ``now``."""
    return df.filter(ttl > now)


def append_expiring(df: DataFrame, path: str) -> None:
    """Append rows with a ``ttl`` in seconds to a table that is partitioned by the day they expire on."""
    df.withColumn(EXPIRY_DAY, F.to_date(F.timestamp_seconds(F.col("ttl")))).write.mode("append").partitionBy(
        EXPIRY_DAY).parquet(path)


def drop_expired(spark: SparkSession, path: str, now: datetime) -> list[str]:
    """Delete the partitions of days that are over; the others are not touched, nor read.

    Rows that expire on the present day stay until it is over; ``unexpired`` hides them.
    """
    over = [name for name in folders.subfolders(spark, path)
            if name.startswith(f"{EXPIRY_DAY}=") and name.split("=", 1)[1] < now.date().isoformat()]
    return [name for name in over if folders.remove(spark, f"{path}/{name}")]


def idle_sessions(sessions: DataFrame, now: Column, days: int = DATASET_RETENTION.days) -> DataFrame:
    """Sessions, as ``current_sessions`` gives them, whose last change is ``days`` days past."""
    return sessions.filter(F.col("updated_at") + F.make_dt_interval(F.lit(days)) <= now).select("session_id")


def decisions(recommended: DataFrame, session: Column, decided_at: Column) -> DataFrame:
    """Decision records from the output of ``recommend_models``."""
    first = F.get("recommended_models", F.lit(0))
    seconds = int(DECISION_RETENTION.total_seconds())
    return recommended.select(
        session.alias("session_id"),
        F.lit("model_recommendation").alias("decision_type"),
        decided_at.alias("timestamp"),
        F.to_json(F.struct("recommended_models", "recommended_preprocessing", "analysis_type")).alias("recommendation"),
        "reasoning",
        F.bround(F.coalesce(first["confidence"], F.lit(0.0)), 4).cast("decimal(10,4)").alias("confidence_score"),
        "analysis_type",
        F.coalesce(first["model"], F.lit("")).alias("primary_model"),
        "source",
        F.to_json(F.struct("num_rows", "num_columns", "missing_percentage", "size_class", "potential_targets"))
        .alias("data_characteristics"),
        (F.unix_timestamp(decided_at) + seconds).alias("ttl"),
    )


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def stored_chart(log: DataFrame, artefacts: DataFrame, chart_type: str) -> DataFrame:
    """Newest stored chart data of a type per session: supervised results first, then unsupervised.

    ``log`` has ``session_id, timestamp, model_type, visualizations``;
    ``artefacts`` lists the paths that still exist in ``path``.
    """
    newest = latest_per_key(log, ["session_id", "model_type"], "timestamp")
    named = (
        newest.select("session_id", "model_type", F.posexplode("visualizations").alias("position", "path"))
        .filter(F.col("path").contains(chart_type))
        .join(artefacts.select("path"), "path", "left_semi")
    )
    rank = F.struct(F.when(F.col("model_type") == "supervised", 0).otherwise(1), "position")
    return named.groupBy("session_id").agg(F.min_by("path", rank).alias("path"))
