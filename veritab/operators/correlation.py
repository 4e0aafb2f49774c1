"""Pearson correlation over pairwise complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.moments import comoments
from veritab.operators.values import name_of
from veritab.schema import numeric_only


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, diagonal: bool = False) -> DataFrame:
    """``(i, j, column_1, column_2, correlation)`` for ``i < j`` (``i <= j`` with ``diagonal``).

    Undefined coefficients (a constant column, fewer than two shared rows) are
    NULL. One scan serves all pairs.
    """
    return _coefficients(df, columns, F.col("i") <= F.col("j") if diagonal else F.col("i") < F.col("j"))


def _coefficients(df: DataFrame, columns: Sequence[str] | None, wanted: Column | None) -> DataFrame:
    columns = numeric_only(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, column_1 string, column_2 string, correlation double")
    found = comoments(df, columns)
    if wanted is not None:
        found = found.filter(wanted)
    value = F.try_divide("co", F.sqrt("dev_i") * F.sqrt("dev_j"))
    return found.select("i", "j", name_of(F.col("i"), columns).alias("column_1"),
                        name_of(F.col("j"), columns).alias("column_2"), value.alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form, diagonal included."""
    return _coefficients(df, columns, None)


def highly_correlated(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs at or above the threshold, with their strength."""
    size = F.abs("correlation")
    return pairs.filter((F.col("i") < F.col("j")) & (size >= threshold)).select(
        "column_1", "column_2", "correlation", F.when(size >= 0.9, "strong").otherwise("moderate").alias("strength"))


def has_high_correlation(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row: does any pair lie strictly above the threshold."""
    return pairs.agg(F.coalesce(
        F.max(F.when(F.col("i") < F.col("j"), F.abs("correlation"))) > threshold, F.lit(False)
    ).alias("has_high_correlation"))


def heatmap_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strict lower triangle: ``(row, column, correlation)``."""
    return correlation_pairs(df, columns).select(
        F.col("column_2").alias("row"), F.col("column_1").alias("column"), "correlation")
