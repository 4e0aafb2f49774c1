"""Sessions: upload, preview, clean, rate, train, chart and recommend over stored datasets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.ml.models import TrainingResult, auto_cluster, train_supervised, train_unsupervised
from veritab.operators import charts, correlation, quality
from veritab.operators.recommendations import request_key
from veritab.plans import reports
from veritab.plans.cleaning import CleaningResult, run_operations
from veritab.schema import numeric_only, scalar_columns
from veritab.session import checkpoint
from veritab.sources import datasets, folders, readers, registry
from veritab.sources.readers import DatasetError

CHARTS = ("correlation_heatmap", "confusion_matrix", "roc_curve", "cluster_plot", "cluster_centers", "cluster_distribution",
          "feature_importance")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Workspace:
    """Datasets and metadata tables under one root folder.

    ``key`` names the column that identifies a row. A dataset without one gets
    it at upload, stored with the rows, so that it never changes afterwards.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "row_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise DatasetError(f"nothing recorded in {name} yet") from error

    def _update(self, session_id: str, **fields: Any) -> None:
        registry.upsert_session(registry.session_frame(
            self.spark, [{"session_id": session_id, "updated_at": _now(), **fields}]), self._path("sessions"))

    def _log(self, *entries: dict[str, Any]) -> None:
        registry.append_log(registry.log_frame(self.spark, entries), self._path("operations"))

    def sessions(self) -> DataFrame:
        return registry.current_sessions(self._table("sessions"))

    def operations(self) -> DataFrame:
        return self._table("operations")

    def dataset(self, session_id: str, version: str = "processed", fallback: bool = True) -> DataFrame:
        return datasets.load_version(self.spark, self._path("datasets"), session_id, version, fallback)

    def _values(self, df: DataFrame) -> DataFrame:
        return df.drop(self.key)

    # --- upload, preview, quality ---------------------------------------------

    def upload(self, path: str, session_id: str | None = None, multi_line: bool = False) -> str:
        """Read a CSV file, store it, record the session and return its id."""
        session_id = session_id or uuid.uuid4().hex
        df = readers.read_csv(self.spark, path, multi_line=multi_line)
        if self.key not in df.columns:
            df = df.withColumn(self.key, F.monotonically_increasing_id())
        stored = datasets.write_version(df, self._path("datasets"), session_id, "original")
        rows = self.spark.read.parquet(stored).count()
        self._update(session_id, file_name=path.rsplit("/", 1)[-1], original_path=stored, row_count=rows,
                     column_count=len(df.columns) - 1)
        return session_id

    def upload_report(self, session_id: str) -> dict[str, DataFrame]:
        return reports.upload_report(self._values(self.dataset(session_id, "original")))

    def preview(self, session_id: str, rows: int = 10) -> dict[str, DataFrame]:
        df = self.dataset(session_id, "original")
        return {**reports.preview_report(self._values(df), rows=rows),
                "rows": df.orderBy(self.key).limit(rows).drop(self.key)}

    def quality(self, session_id: str) -> dict[str, DataFrame]:
        return reports.quality_report(self._values(self.dataset(session_id)))

    # --- cleaning ---------------------------------------------------------------

    def preprocess(self, session_id: str, operations: Sequence[dict[str, Any]]) -> CleaningResult:
        """Clean the original dataset, store the result, log every step and rate the outcome."""
        result = run_operations(self.dataset(session_id, "original"), operations, session_id, protect=(self.key,))
        stored = datasets.write_version(result.data, self._path("datasets"), session_id, "processed")
        result.data = self.dataset(session_id)
        self._log(*[{**e, "details": {k: v for k, v in (e.get("details") or {}).items() if k != "mappings"}}
                    for e in result.log])
        values = self._values(result.data)
        score = quality.quality_summary(values.select(*scalar_columns(values))).first()["overall_quality_score"]
        self._update(session_id, processed_path=stored, quality_score=score)
        return result

    def export(self, session_id: str, path: str) -> str:
        return datasets.export_csv(self._values(self.dataset(session_id)), path)

    # --- training ---------------------------------------------------------------

    def train(self, session_id: str, algorithm: str, target: str | None = None,
              features: Sequence[str] | None = None, parameters: dict[str, Any] | None = None) -> TrainingResult:
        """Train on the processed dataset, store the chart data and log the outcome, also a failure."""
        operation_id, kind = uuid.uuid4().hex, "supervised" if target else "unsupervised"
        entry = {"session_id": session_id, "operation_type": "training", "model_type": kind,
                 "operation_id": operation_id, "action": algorithm, "parameters": parameters or {}}
        try:
            df = self.dataset(session_id, "processed", fallback=False)
            result = (
                train_supervised(df, algorithm, target, self.key, features, parameters) if target
                else train_unsupervised(df, algorithm, self.key, features, parameters))
            metrics = result.metrics.first().asDict()
            saved = [self._save_chart(session_id, name, operation_id, data)
                     for name, data in self._training_charts(df, result).items()]
        except Exception as error:
            self._log({**entry, "timestamp": _now(), "status": "failed", "error": str(error)})
            raise
        self._log({**entry, "timestamp": _now(), "status": "completed", "details": {
            "metrics": metrics, "feature_columns": result.feature_columns, "target_column": target,
            "visualizations": saved}})
        result.extra["operation_id"] = operation_id
        return result

    def _training_charts(self, df: DataFrame, result: TrainingResult) -> dict[str, DataFrame]:
        found: dict[str, DataFrame] = {}
        if result.model_type == "supervised":
            found["confusion_matrix"] = charts.confusion_matrix(
                result.predictions, "label", "prediction", grid=True)
            if "score" in result.predictions.columns:
                found["roc_curve"] = charts.roc_points(result.predictions, "label", "score", result.classes[1])
            if result.importances and len(result.importances) == len(result.feature_columns):
                found["feature_importance"] = charts.given_importance(
                    self.spark, result.feature_columns, result.importances)
            return found
        found["cluster_distribution"] = charts.cluster_sizes(result.predictions, "label")
        axes = numeric_only(df, result.feature_columns)[:2]
        if len(axes) == 2:
            joined = df.join(result.predictions.withColumnRenamed("key", self.key), self.key)
            found["cluster_plot"] = charts.cluster_scatter(joined, "label", *axes)
            if result.centers:
                x, y = (result.feature_columns.index(c) for c in axes)
                found["cluster_centers"] = self.spark.createDataFrame(
                    [(i, c[x], c[y]) for i, c in enumerate(result.centers)], "label int, x double, y double")
        return found

    def training_status(self, session_id: str, operation_id: str) -> DataFrame:
        return registry.operation_status(self.operations().filter(
            (F.col("session_id") == session_id) & (F.col("operation_id") == operation_id)))

    # --- charts -----------------------------------------------------------------

    def _save_chart(self, session_id: str, name: str, operation_id: str, data: DataFrame) -> str:
        path = f"{self._path('charts')}/{session_id}/{name}_{operation_id}"
        data.write.parquet(path)
        self.spark.createDataFrame([(path,)], "path string").write.mode("append").parquet(self._path("artefacts"))
        return path

    def chart(self, session_id: str, chart_type: str, **options: Any) -> DataFrame:
        """Chart data: stored by training if there is any, else computed from the dataset."""
        if chart_type not in CHARTS:
            raise ValueError(f"unknown chart type: {chart_type}")
        if chart_type == "correlation_heatmap":
            return correlation.heatmap_cells(self._values(self.dataset(session_id)))
        stored = self._stored_chart(session_id, chart_type)
        if stored is not None:
            return stored
        if chart_type in ("cluster_plot", "cluster_centers"):
            return auto_cluster(self.dataset(session_id), self.key, **options)[chart_type == "cluster_centers"]
        if chart_type == "feature_importance":
            return charts.variance_importance(self._values(self.dataset(session_id)))
        raise DatasetError(f"no stored {chart_type}; train a model first")

    def _stored_chart(self, session_id: str, chart_type: str) -> DataFrame | None:
        try:
            log = self.operations().filter(
                (F.col("session_id") == session_id) & (F.col("operation_type") == "training")
                & (F.col("status") == "completed"))
            artefacts = self._table("artefacts")
        except DatasetError:
            return None
        listed = log.withColumn(
            "visualizations", F.from_json("details", "visualizations array<string>")["visualizations"])
        row = registry.stored_chart(
            listed.select("session_id", "timestamp", "model_type", "visualizations"), artefacts, chart_type).first()
        return self.spark.read.parquet(row["path"]) if row else None

    # --- recommendations --------------------------------------------------------

    def recommend(self, session_id: str) -> dict[str, DataFrame]:
        """Recommendations; ``models`` has ``cached``, true when the same description was answered within a day.

        A cached answer is served as it was stored, a fresh one comes from the rules and is stored.
        """
        found = reports.recommendation_report(self._values(self.dataset(session_id)), session_id)
        models = found["models"]
        answer = models.schema["recommended_models"].dataType
        now = F.lit(_now())
        try:
            probed = registry.cache_probe(
                request_key(models), self._table("responses"), "prompt_hash", "stored", now)
            stored = F.from_json("cached.response", answer)
        except DatasetError:
            probed, stored = request_key(models).withColumn("hit", F.lit(False)), F.lit(None).cast(answer)
        # Written before the new answers are, which would look like hits otherwise.
        served = checkpoint(probed.withColumn("cached", F.when(F.col("hit"), stored)).select(
            *[F.coalesce("cached", c).alias(c) if c == "recommended_models" else F.col(c) for c in models.columns],
            "prompt_hash", F.col("hit").alias("cached")))
        registry.append_expiring(served.filter(~F.col("cached")).select(
            "prompt_hash", F.to_json("recommended_models").alias("response"), now.alias("stored"),
            (F.unix_timestamp(now) + registry.CACHE_LIFETIME_HOURS * 3600).alias("ttl")), self._path("responses"))
        found["models"] = served.drop("prompt_hash")
        registry.append_expiring(registry.decisions(found["models"], F.lit(session_id), now), self._path("decisions"))
        self._log({"session_id": session_id, "timestamp": _now(), "operation_type": "ai_recommendation",
                   "status": "completed"})
        return found

    # --- retention ----------------------------------------------------------------

    def expire(self, now: datetime | None = None) -> dict[str, list[str]]:
        """Delete what has outlived its time: days of cached answers and decisions, datasets and charts of idle sessions.

        Only folders that expire are touched, one at a time, each taken out of sight
        before it is deleted. Their names are returned.
        """
        now = now or _now()
        gone = {name: registry.drop_expired(self.spark, self._path(name), now) for name in ("responses", "decisions")}
        idle = registry.idle_sessions(self.sessions(), F.lit(now)).toLocalIterator()
        gone["sessions"] = [row["session_id"] for row in idle if [
            kind for kind in ("datasets", "charts") if folders.remove(self.spark, self._path(f"{kind}/{row['session_id']}"))]]
        return gone
