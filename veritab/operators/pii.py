"""Scan of text columns for personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.schema import categorical, col, require_columns

# The patterns that define each kind of personal data.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}

# Fixed value: the message shown when anything is found.
PII_WARNING = (
    "Personally Identifiable Information (PII) detected in dataset. Please review data privacy compliance."
)


def pii_scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sample_rows: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """``(column, pii_type, matches, rows_with_match)`` over all rows.

    Text columns are scanned unless ``columns`` names others, which are read as
    text. ``sample_rows`` asks for the first rows (in ``key`` order) only.
    """
    chosen = categorical(df) if columns is None else list(columns)
    require_columns(df, chosen)
    if not chosen:
        return df.sparkSession.createDataFrame(
            [], "column string, pii_type string, matches bigint, rows_with_match bigint")
    if sample_rows is not None:
        df = (df.orderBy(col(key)) if key else df).limit(sample_rows)
    found = [
        (i, kind, F.regexp_count(col(c).cast("string"), F.lit(pattern)).alias(f"{kind}_{i}"))
        for i, c in enumerate(chosen) for kind, pattern in PII_PATTERNS.items()
    ]
    counts = df.select(*[expression for _, _, expression in found])
    totals = counts.agg(*[
        m for i, kind, _ in found for m in (
            F.coalesce(F.sum(f"{kind}_{i}"), F.lit(0)).alias(f"m_{kind}_{i}"),
            F.count_if(F.col(f"{kind}_{i}") > 0).alias(f"r_{kind}_{i}"),
        )
    ])
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(chosen[i]).alias("column"), F.lit(kind).alias("pii_type"),
            F.col(f"m_{kind}_{i}").alias("matches"), F.col(f"r_{kind}_{i}").alias("rows_with_match"),
        ) for i, kind, _ in found
    ])))


def pii_summary(scan: DataFrame) -> DataFrame:
    """One row per dataset: flag, matches per kind found, and the warning."""
    kinds = scan.groupBy("pii_type").agg(F.sum("matches").alias("matches"))
    found = F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("matches") > 0, F.struct("pii_type", "matches")))))
    detected = F.coalesce(F.sum("matches"), F.lit(0)) > 0
    return kinds.agg(
        detected.alias("pii_detected"), found.alias("pii_details"),
        F.when(detected, PII_WARNING).alias("warning_message"),
    )
