"""The whole journey of one dataset, on the ten-row frame and on a table."""

import pytest
from pyspark.sql import functions as F

from veritab.plans.workspace import Workspace
from veritab.session import scratch_folder
from veritab.sources.readers import DatasetError


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace(spark, scratch_folder(spark))


def test_ten_rows_end_to_end(spark, ten, workspace):
    path = f"{scratch_folder(spark)}/data.csv"
    ten.coalesce(1).write.option("header", True).csv(path)
    session = workspace.upload(path)
    upload = workspace.upload_report(session)
    assert upload["basic_metrics"].first()["total_cells"] == 30
    assert upload["pii_summary"].first()["pii_detected"] is False
    preview = workspace.preview(session)
    assert preview["rows"].count() == 10
    assert preview["missing_summary"].first()["missing_percentage"] == 6.67
    assert workspace.quality(session)["summary"].first()["overall_quality_score"] == 91.7
    with pytest.raises(DatasetError):
        workspace.train(session, "kmeans")
    assert workspace.operations().first()["status"] == "failed"

    result = workspace.preprocess(session, [
        {"operation": "handle_missing", "method": "fill", "columns": ["numeric_col", "mixed_col"]},
        {"operation": "scale_features", "method": "standard"},
    ])
    assert (result.completed, result.failed) == (2, 0)
    stats = result.data.agg(F.avg("numeric_col"), F.stddev_pop("numeric_col"), F.count("numeric_col")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] == 10
    row = workspace.sessions().first()
    assert row["dataset_path"] == row["processed_path"] and row["quality_score"] > 91.7
    assert workspace.operations().filter("operation_type = 'preprocessing'").count() == 2

    found = workspace.recommend(session)
    assert found["characteristics"].first()["size_class"] == "small"
    assert not found["models"].first()["cached"]
    again = workspace.recommend(session)["models"].first()
    assert again["cached"] and again["recommended_models"] == found["models"].first()["recommended_models"]
    assert spark.read.parquet(f"{workspace.root}/responses").count() == 1
    assert spark.read.parquet(f"{workspace.root}/decisions").count() == 2


def test_training_stores_charts(spark, workspace):
    path = f"{scratch_folder(spark)}/points.csv"
    spark.range(120).select(
        (F.col("id") % 7).alias("a"), (F.when(F.col("id") < 60, 0).otherwise(9) + F.col("id") % 3).alias("b"),
        F.when(F.col("id") < 60, "low").otherwise("high").alias("y")).write.option("header", True).csv(path)
    session = workspace.upload(path)
    workspace.preprocess(session, [{"operation": "handle_missing", "method": "drop"}])
    assert workspace.chart(session, "feature_importance").count() == 2
    result = workspace.train(session, "random_forest", "y", parameters={"n_estimators": 5})
    assert result.metrics.first()["accuracy"] == 1.0
    status = workspace.training_status(session, result.extra["operation_id"]).first()
    assert status["status"] == "completed" and "accuracy" in status["results"]
    assert workspace.chart(session, "confusion_matrix").agg(F.sum("n")).first()[0] == 24
    assert workspace.chart(session, "roc_curve").count() > 0
    assert {r["feature"] for r in workspace.chart(session, "feature_importance").collect()} == {"a", "b"}
    assert workspace.chart(session, "correlation_heatmap").count() == 1
    assert workspace.chart(session, "cluster_plot", restarts=1).count() == 120
    workspace.train(session, "kmeans", features=["a", "b"], parameters={"n_clusters": 2})
    assert workspace.chart(session, "cluster_centers").count() == 2
    assert workspace.chart(session, "cluster_distribution").agg(F.sum("n")).first()[0] == 120
    with pytest.raises(ValueError):
        workspace.chart(session, "pie")
