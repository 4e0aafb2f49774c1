"""Logical column types, derived from the schema alone (no job is started)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def logical_type(data_type: T.DataType) -> str:
    """One of integer, float, boolean, datetime, categorical, or the Spark type name."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _INTEGRAL):
        return "integer"
    if isinstance(data_type, _FRACTIONAL):
        return "float"
    if isinstance(data_type, _TEMPORAL):
        return "datetime"
    if isinstance(data_type, _TEXT):
        return "categorical"
    return data_type.typeName()


def column_types(df: DataFrame) -> dict[str, str]:
    return {field.name: logical_type(field.dataType) for field in df.schema.fields}


def _of_type(df: DataFrame, kinds: Iterable[str], columns: Iterable[str] | None = None) -> list[str]:
    types = column_types(df)
    wanted = df.columns if columns is None else columns
    return [name for name in wanted if types.get(name) in kinds]


def numeric_only(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_type(df, ("integer", "float"), columns)


def numeric_or_bool(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_type(df, ("integer", "float", "boolean"), columns)


def categorical(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_type(df, ("categorical",), columns)


def scalar_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Columns with a flat value; arrays, maps, structs and binaries are left out."""
    return _of_type(df, ("integer", "float", "boolean", "datetime", "categorical"), columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def as_double(name: str) -> Column:
    return col(name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Leave NULL as the only missing value: NaN becomes NULL in float columns."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(name)), col(name)).alias(name) if name in floats else col(name)
        for name in df.columns
    ])
