"""Dataset characteristics and target candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.numeric import percent
from veritab.operators.correlation import correlation_pairs, has_high_correlation
from veritab.operators.values import distinct_counts
from veritab.schema import col, column_types, scalar_columns

TARGET_TYPE = "array<struct<column: string, unique_values: bigint, type: string>>"


def column_overview(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """One row per column: position, type, total, missing and distinct counts."""
    columns = scalar_columns(df, columns)
    types = column_types(df)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    long = wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"),
            F.col("rows").alias("total_count"), F.col(f"m{i}").alias("missing_count"),
        ) for i, c in enumerate(columns)
    ])))
    return long.join(distinct_counts(df, columns, exact_distinct), "column")


def target_candidates(overview: DataFrame) -> DataFrame:
    """Columns that could be predicted, in order: classification first, then regression.

    Classification: 2 to 20 distinct values and fewer than a tenth of the rows.
    Regression: numeric, more than 20 distinct values and more than half the rows.
    """
    distinct, rows = F.col("distinct_count"), F.col("total_count")
    kind = (
        F.when(distinct.between(2, 20) & (distinct < rows * 0.1), "classification")
        .when(F.col("data_type").isin("integer", "float") & (distinct > 20) & (distinct > rows * 0.5), "regression")
    )
    return overview.select(
        F.when(kind == "classification", 0).otherwise(1).alias("kind_rank"), "position", "column",
        distinct.alias("unique_values"), kind.alias("type"),
    ).filter(F.col("type").isNotNull())


def dataset_characteristics(
    df: DataFrame,
    dataset: str,
    columns: Sequence[str] | None = None,
    exact_distinct: bool = True,
) -> DataFrame:
    """One row that describes the dataset; the input of the recommendation rules."""
    columns = scalar_columns(df, columns)
    overview = column_overview(df, columns, exact_distinct)
    targets = target_candidates(overview)
    types = F.col("data_type")

    def ordered_names(keep: Column) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(keep, F.struct("position", "column")))), lambda s: s["column"])

    per_column = overview.agg(
        F.max("total_count").alias("num_rows"),
        F.count(F.lit(1)).cast("int").alias("num_columns"),
        F.count_if(types.isin("integer", "float")).cast("int").alias("numeric_columns"),
        F.count_if(types == "categorical").cast("int").alias("categorical_columns"),
        F.count_if(types == "boolean").cast("int").alias("boolean_columns"),
        F.count_if(types == "datetime").cast("int").alias("datetime_columns"),
        ordered_names(types.isin("integer", "float")).alias("numeric_column_names"),
        ordered_names(types == "categorical").alias("categorical_column_names"),
        F.sum("missing_count").alias("missing_values"),
        percent(F.sum("missing_count"), F.sum("total_count")).alias("missing_percentage"),
        ordered_names((types == "categorical") & (F.col("distinct_count") > 50)).alias("high_cardinality_columns"),
    )
    found = targets.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("kind_rank", "position", "column", "unique_values", "type"))),
            lambda s: F.struct(s["column"].alias("column"), s["unique_values"].alias("unique_values"),
                               s["type"].alias("type")),
        ).cast(TARGET_TYPE).alias("potential_targets"))
    high = has_high_correlation(correlation_pairs(df, columns))
    union = per_column.unionByName(found, allowMissingColumns=True).unionByName(high, allowMissingColumns=True)
    row = union.agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns])
    return row.select(
        F.lit(dataset).alias("dataset"), *per_column.columns, "potential_targets", "has_high_correlation",
        F.when(F.col("num_rows") < 100, "small").when(F.col("num_rows") < 10000, "medium").otherwise("large")
        .alias("size_class"),
        (F.col("missing_values") > 0).alias("has_missing_values"),
        (F.col("categorical_columns") > 0).alias("has_categorical"),
    )
