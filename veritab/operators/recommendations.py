"""Rules over profile tables (one row per dataset), written as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import text_hash

MODEL_TYPE = "array<struct<model: string, confidence: double, reasoning: string>>"
STEP_TYPE = "array<struct<step: string, reasoning: string>>"

# Model suggestions (name, confidence, reasoning) by situation.
SMALL_CLASSIFICATION = [
    ("logistic_regression", 0.8, "Good baseline for small classification datasets"),
    ("knn", 0.65, "Works well with small to medium datasets"),
    ("random_forest", 0.75, "Provides feature importance and handles mixed data types"),
]
LARGE_CLASSIFICATION = [
    ("random_forest", 0.85, "Robust ensemble method for medium to large datasets with mixed features"),
    ("svm", 0.7, "Effective for classification with clear margins"),
]
REGRESSION = [("random_forest", 0.8, "Robust for regression tasks with non-linear relationships")]
CLUSTERING = [
    ("kmeans", 0.75, "Standard clustering for discovering groups in the data"),
    ("dbscan", 0.6, "Density-based clustering that can find arbitrary-shaped clusters"),
]

# Preprocessing steps and their reasons.
LABEL_REASON = (
    "High cardinality categorical columns found - label encoding recommended to avoid dimensionality explosion"
)
ONE_HOT_REASON = "Low-cardinality categorical columns - one-hot encoding preserves information"
SCALING_REASON = "Scaling numeric features for better model performance"
OUTLIER_REASON = "High correlations detected - removing outliers may improve model accuracy"


def _models(rows: list[tuple[str, float, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("confidence"), F.lit(r).alias("reasoning"))
        for m, c, r in rows
    ]).cast(MODEL_TYPE)


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _join_first(names: Column, k: int = 3) -> Column:
    return F.array_join(F.slice(names, 1, k), ", ")


def recommend_models(characteristics: DataFrame) -> DataFrame:
    """Add analysis type, suggested models and suggested preprocessing to each dataset row."""
    target = F.get("potential_targets", F.lit(0))["type"]
    analysis = (
        F.when(target == "classification", "supervised_classification")
        .when(target == "regression", "supervised_regression")
        .otherwise("unsupervised_clustering")
    )
    models = (
        F.when((target == "classification") & (F.col("num_rows") < 1000), _models(SMALL_CLASSIFICATION))
        .when(target == "classification", _models(LARGE_CLASSIFICATION))
        .when(target == "regression", _models(REGRESSION))
        .otherwise(_models(CLUSTERING))
    )
    share = F.col("missing_percentage")
    shown = share.cast("string")

    def step(name: str, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), reason.alias("reasoning"))

    imputation = F.when(
        F.col("has_missing_values"),
        F.when(share < 5, step("fill_null_mean", F.concat(
            F.lit("Low missing value percentage ("), shown, F.lit("%), mean imputation suitable"))))
        .when(share < 20, step("fill_null_median", F.concat(
            F.lit("Moderate missing values ("), shown, F.lit("%), median imputation is more robust"))))
        .otherwise(step("remove_null", F.concat(
            F.lit("High missing value percentage ("), shown, F.lit("%), consider removing rows")))),
    )
    encoding = F.when(
        F.col("has_categorical"),
        F.when(F.size("high_cardinality_columns") > 0, step("label_encoding", F.lit(LABEL_REASON)))
        .otherwise(step("one_hot_encoding", F.lit(ONE_HOT_REASON))),
    )
    scaling = F.when(
        (F.col("numeric_columns") > 0) & (analysis != "unsupervised_clustering"),
        step("standard_scaling", F.lit(SCALING_REASON)))
    outliers = F.when(F.col("has_high_correlation"), step("outlier_removal_iqr", F.lit(OUTLIER_REASON)))
    return characteristics.select(
        "*",
        analysis.alias("analysis_type"),
        models.alias("recommended_models"),
        _compact(imputation, encoding, scaling, outliers).cast(STEP_TYPE).alias("recommended_preprocessing"),
        F.format_string(
            "Rule-based analysis for %s dataset with %d rows and %d columns.",
            "size_class", "num_rows", "num_columns").alias("reasoning"),
        F.lit("rule_based_fallback").alias("source"),
    )


def quality_recommendations(summary: DataFrame) -> DataFrame:
    """Add the ordered list of plain-text recommendations to each ``quality_summary`` row."""
    missing, duplicates, score = F.col("total_missing_percentage"), F.col("duplicate_percentage"), F.col(
        "overall_quality_score")
    messages = _compact(
        F.when(missing > 20,
               "High percentage of missing values detected - consider data collection improvements")
        .when(missing > 10, "Moderate missing values - implement imputation strategies"),
        F.when(F.size("high_missing_columns") > 0, F.concat(
            F.lit("Consider removing columns with >50% missing values: "), _join_first(F.col("high_missing_columns")))),
        F.when(duplicates > 10, "High number of duplicate rows - remove duplicates to improve data quality")
        .when(duplicates > 1, "Some duplicate rows detected - consider deduplication"),
        F.when(F.size("severely_imbalanced_columns") > 0,
               "Severe class imbalance detected - consider resampling techniques")
        .when(F.size("moderately_imbalanced_columns") > 0,
              "Moderate class imbalance - monitor model performance carefully"),
        F.when(F.size("columns_with_many_outliers") > 0, F.concat(
            F.lit("Many outliers detected in: "), _join_first(F.col("columns_with_many_outliers")))),
        F.when(F.size("potential_conversions") > 0,
               "Some columns may benefit from type conversion for better analysis"),
        F.when(score >= 80, "Dataset quality is excellent for analysis")
        .when(score >= 60, "Dataset quality is good with minor improvements needed")
        .when(score >= 40, "Dataset quality is moderate - several improvements recommended")
        .otherwise("Dataset quality is poor - significant preprocessing required"),
    )
    return summary.withColumn("recommendations", messages)


def quality_actions(summary: DataFrame) -> DataFrame:
    """Explode each ``quality_summary`` row into prioritised actions.

    The imbalance ratio here is most to least frequent, the inverse of the summary's.
    """
    missing, score = F.col("total_missing_percentage"), F.col("overall_quality_score")
    ratio = F.try_divide(F.lit(1.0), F.col("overall_imbalance_ratio"))

    def action(category: str, name: str, priority: str, reason: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit(name).alias("action"),
            F.lit(priority).alias("priority"), reason.alias("reasoning"))

    def said(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value.cast("string"), F.lit(after))

    found = _compact(
        F.when(missing > 0, F.when(missing < 5, action(
            "missing_values", "fill_null", "low",
            said("Minor missing values (", missing, "%) - simple imputation recommended")))
            .when(missing < 20, action(
                "missing_values", "fill_null_median", "medium",
                said("Moderate missing values (", missing, "%) - median imputation recommended")))
            .otherwise(action(
                "missing_values", "review_columns", "high",
                said("Significant missing values (", missing, "%) - review columns with high missing rates")))),
        F.when(F.col("duplicate_rows") > 0, action(
            "duplicates", "remove_duplicates", "medium",
            said("", F.col("duplicate_rows"),
                 " duplicate rows detected - removal recommended for better model performance"))),
        F.when(ratio > 3.0, action(
            "class_imbalance", "consider_sampling", "high",
            F.format_string(
                "Class imbalance detected (ratio: %.1f) - consider oversampling minority class or using "
                "balanced models", ratio))),
        F.when(score < 50, action(
            "overall", "extensive_preprocessing", "high",
            said("Low quality score (", score, "/100) - extensive data cleaning recommended before modeling")))
        .when(score < 75, action(
            "overall", "moderate_preprocessing", "medium",
            said("Moderate quality score (", score, "/100) - some preprocessing recommended"))),
    )
    kept = [c for c in summary.columns if c == "dataset"]
    return summary.select(*kept, F.posexplode(found).alias("position", "_a")).select(
        *kept, "position", "_a.category", "_a.action", "_a.priority", "_a.reasoning")


def display_strings(recommended: DataFrame) -> DataFrame:
    """The suggestions of ``recommend_models`` as lines of text."""
    return recommended.select(
        "dataset",
        F.transform("recommended_models", lambda m: F.concat(
            m["model"], F.lit(" (confidence: "), F.bround(m["confidence"] * 100, 0).cast("int").cast("string"),
            F.lit("%) - "), m["reasoning"])).alias("model_suggestions"),
        F.transform("recommended_preprocessing", lambda s: F.concat(s["step"], F.lit(" - "), s["reasoning"]))
        .alias("preprocessing_suggestions"),
        F.array("reasoning").alias("feature_engineering_ideas"),
    )


def action_strings(actions: DataFrame) -> DataFrame:
    """Each action as ``[priority] action - reasoning``."""
    return actions.withColumn(
        "text", F.concat(F.lit("["), "priority", F.lit("] "), "action", F.lit(" - "), "reasoning"))


def request_key(characteristics: DataFrame) -> DataFrame:
    """Add the hash that identifies equal dataset descriptions, the key of the response cache."""
    described = [
        "num_rows", "num_columns", "numeric_columns", "categorical_columns", "missing_percentage", "size_class",
        "has_high_correlation", "has_categorical", "potential_targets",
    ]
    description = F.to_json(F.struct(*described))
    return characteristics.withColumn("description", description).withColumn("prompt_hash", text_hash(description))
