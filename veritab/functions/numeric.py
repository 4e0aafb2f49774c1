"""Small numeric expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to 2 places, ties to even; 0 when the whole is 0."""
    return F.coalesce(F.bround(F.try_divide(part, whole) * 100.0, 2), F.lit(0.0))


def log_number(value: Column) -> Column:
    """Decimal text with 10 places for log records, of any size; NaN becomes NULL.

    A decimal column ends at 28 digits before the point, which a model's metric may
    pass, so the number is carried as the text of its value rounded to 10 places.
    Numbers of 1e15 and more have no such places and keep all their digits.
    """
    number = value.cast("double")
    finite = F.when(~F.isnan(number), number)
    small = F.round(finite, 10).try_cast("decimal(38,10)").cast("string")
    return F.when(F.abs(finite) < 1e15, small).otherwise(finite.cast("string"))


def from_log_number(value: Column) -> Column:
    return value.cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    """Restrict to ``[low, high]``; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))
