"""Value histograms: one shuffle serves distinct counts, top values, modes and imbalance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritab.schema import col, column_types, require_columns, scalar_columns


def _carrier(data_type: T.DataType) -> str:
    """The type a column's values are counted in; columns with one carrier share a shuffle."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return data_type.simpleString()
    return "string"


def name_of(position: Column, columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), position)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for every distinct non-null value; values as text.

    Cells are counted in a typed carrier, keyed by column position, and turned
    into text only once per distinct value.
    """
    columns = scalar_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    families: dict[str, list[int]] = {}
    for i, name in enumerate(columns):
        families.setdefault(_carrier(df.schema[name].dataType), []).append(i)
    counted = []
    for carrier, members in families.items():
        cells = df.select(*[col(columns[i]).cast(carrier).alias(str(i)) for i in members])
        if len(members) == 1:
            long = cells.select(F.lit(members[0]).alias("position"), F.col(str(members[0])).alias("value"))
        else:
            long = cells.unpivot([], [str(i) for i in members], "position", "value").withColumn(
                "position", F.col("position").cast("int"))
        counted.append(
            long.filter(F.col("value").isNotNull())
            .groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
            .select("position", F.col("value").cast("string").alias("value"), "n")
        )
    return reduce(DataFrame.unionAll, counted).select(name_of(F.col("position"), columns).alias("column"), "value", "n")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, ties by ascending value."""
    window = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``(column, distinct_count)`` over non-null values; columns without values report 0."""
    columns = scalar_columns(df, columns)
    if not exact:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(columns)
        ])))
    found = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the most frequent value per column, ties to the smallest value.

    Numbers are compared as numbers and text as text.
    """
    types = column_types(df)
    rank = F.struct(
        (-F.col("n")).alias("n"),
        F.when(F.col("column").isin([c for c in columns if types[c] in ("integer", "float")]),
               F.expr("try_cast(value AS double)")).alias("number"),
        F.col("value").alias("text"),
    )
    return value_counts(df, columns).groupBy("column").agg(
        F.min_by("value", rank).alias("value"), F.max("n").alias("n"))


def sample_values(df: DataFrame, column: str, key: str, k: int = 5) -> DataFrame:
    """The first ``k`` non-null values of a column in key order."""
    require_columns(df, [column, key])
    return (
        df.filter(col(column).isNotNull()).orderBy(col(key)).limit(k)
        .select(F.lit(column).alias("column"), col(column).cast("string").alias("value"))
    )
