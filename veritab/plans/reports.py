"""Reports put together from the operators; every part stays a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veritab.operators import correlation, pii, profile, quality, values
from veritab.operators.characteristics import dataset_characteristics
from veritab.operators.recommendations import (
    display_strings, quality_actions, quality_recommendations, recommend_models,
)
from veritab.schema import scalar_columns


def upload_report(df: DataFrame) -> dict[str, DataFrame]:
    """What is shown after a dataset arrives: its profile and the personal-data scan."""
    scan = pii.pii_scan(df)
    return {
        "basic_metrics": profile.basic_metrics(df),
        "column_statistics": profile.column_statistics(df),
        "pii": scan,
        "pii_summary": pii.pii_summary(scan),
    }


def preview_report(df: DataFrame, key: str | None = None, rows: int = 10) -> dict[str, DataFrame]:
    """First rows, column statistics, top values, missing summary, types and correlations."""
    statistics = profile.column_statistics(df)
    return {
        "rows": profile.preview(df, key, rows),
        "size": profile.preview_size(df, rows),
        "column_statistics": statistics,
        "top_values": values.top_values(df),
        "missing_summary": profile.dataset_missing_summary(statistics),
        "type_histogram": profile.type_histogram(statistics),
        "correlation_matrix": correlation.correlation_matrix(df),
        "high_correlations": correlation.highly_correlated(correlation.correlation_pairs(df)),
    }


def quality_report(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every quality analysis, the overall score and the recommendations. Errors are not swallowed."""
    df = df.select(*scalar_columns(df, columns))
    return {
        "basic_metrics": profile.basic_metrics(df),
        "missing": quality.missing_by_column(df),
        "duplicates": quality.duplicate_summary(df),
        "imbalance": quality.imbalance_by_column(df),
        "types": profile.infer_types(df),
        "outliers": quality.outlier_counts(df),
        "summary": quality_recommendations(quality.quality_summary(df)),
    }


def recommendation_report(df: DataFrame, dataset: str) -> dict[str, DataFrame]:
    """Characteristics, model and preprocessing suggestions, and quality-driven actions."""
    characteristics = dataset_characteristics(df, dataset)
    models = recommend_models(characteristics)
    return {
        "characteristics": characteristics,
        "models": models,
        "display": display_strings(models),
        "actions": quality_actions(quality.quality_summary(df.select(*scalar_columns(df)))),
    }
