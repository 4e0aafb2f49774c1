"""Column and dataset profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.functions.dates import ISO, common_format, with_date_parts
from veritab.functions.numeric import percent
from veritab.functions.quantiles import BUFFER_ROWS, exact_quantiles
from veritab.operators.values import distinct_counts, value_counts
from veritab.schema import as_double, col, column_types, numeric_only, require_columns, scalar_columns

QUARTILES = (0.25, 0.5, 0.75)


def quartile_arrays(
    df: DataFrame,
    columns: Sequence[str],
    buffer_rows: int = BUFFER_ROWS,
    probabilities: Sequence[float] = QUARTILES,
) -> dict[str, Column]:
    """An array of quantiles per column, usable inside ``df.agg``; the selection has run by then."""
    found = exact_quantiles(df, columns, probabilities, buffer_rows)
    return {c: F.array(*[F.lit(v).cast("double") for v in found[c]]) for c in columns}


def column_statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact_distinct: bool = True,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """One row per column: type, counts, and the statistics that fit the type.

    All moments and counts come from one aggregation over the table, quantiles
    from a radix selection over all columns, distinct counts from the value histogram.
    """
    columns = scalar_columns(df, columns)
    if not columns:
        nothing = df.sparkSession.createDataFrame([], "none string")
        return column_statistics(nothing).filter(F.lit(False))
    types = column_types(df)
    numeric = numeric_only(df, columns)
    quartiles = quartile_arrays(df, numeric, buffer_rows)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        measures.append(F.count(col(c)).alias(f"n{i}"))
        if c in quartiles:
            x = as_double(c)
            measures += [
                F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                quartiles[c].alias(f"q{i}"),
            ]
        elif types[c] == "boolean":
            measures.append(F.count_if(col(c)).alias(f"true{i}"))
    wide = df.agg(*measures)

    def entry(i: int, c: str) -> Column:
        nothing, no_count = F.lit(None).cast("double"), F.lit(None).cast("bigint")
        numbers, flags = c in quartiles, types[c] == "boolean"
        present = F.col(f"n{i}")
        # A single value has no sample deviation; the profile reports it as 0.
        std = F.when(present > 0, F.coalesce(F.col(f"std{i}"), F.lit(0.0))) if numbers else nothing
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("data_type"),
            F.col("rows").alias("total_count"),
            (F.col("rows") - present).alias("missing_count"),
            percent(F.col("rows") - present, F.col("rows")).alias("missing_percentage"),
            (F.col(f"mean{i}") if numbers else nothing).alias("mean"),
            (F.get(f"q{i}", F.lit(1)) if numbers else nothing).alias("median"),
            std.alias("std"),
            (F.col(f"min{i}") if numbers else nothing).alias("min"),
            (F.col(f"max{i}") if numbers else nothing).alias("max"),
            (F.get(f"q{i}", F.lit(0)) if numbers else nothing).alias("q25"),
            (F.get(f"q{i}", F.lit(2)) if numbers else nothing).alias("q75"),
            (F.col(f"true{i}") if flags else no_count).alias("true_count"),
            (present - F.col(f"true{i}") if flags else no_count).alias("false_count"),
            (percent(F.col(f"true{i}"), present) if flags else nothing).alias("true_percentage"),
        )

    long = wide.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    return long.join(distinct_counts(df, columns, exact_distinct), "column")


def dataset_missing_summary(statistics: DataFrame) -> DataFrame:
    """One row over the output of ``column_statistics``: missing cells in the whole dataset."""
    return statistics.agg(
        F.sum("missing_count").alias("total_missing"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        percent(F.sum("missing_count"), F.sum("total_count")).alias("missing_percentage"),
    )


def type_histogram(statistics: DataFrame) -> DataFrame:
    """Columns per logical type."""
    return statistics.groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))


def basic_metrics(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(width).alias("total_columns"),
        (F.col("total_rows") * width).alias("total_cells"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("column_names"),
    )


def preview(df: DataFrame, key: str | None = None, rows: int = 10) -> DataFrame:
    """The first rows, in key order when a key is given."""
    if key is None:
        return df.limit(rows)
    require_columns(df, [key])
    return df.orderBy(col(key)).limit(rows)


def preview_size(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows_available")).select(
        F.least(F.col("total_rows_available"), F.lit(rows)).alias("rows_shown"), "total_rows_available")


# Fixed value: what counts as a number written as text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Deep typing: text columns that hold only numbers, or only dates of one format, are named as such.

    ``date_format`` is the pattern all values share (month before day where both
    fit), or ISO for texts that Spark casts to a timestamp. The same scan counts
    the rows and missing cells of every column.
    """
    columns = df.columns if columns is None else list(columns)
    require_columns(df, columns)
    if not columns:
        nothing = df.sparkSession.createDataFrame([], "none string")
        return infer_types(nothing).filter(F.lit(False))
    types = column_types(df)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    texts = {f"c{i}": f"d{i}" for i, c in enumerate(columns) if types[c] == "categorical"}
    cells = with_date_parts(df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]), texts)
    measures = [F.count(F.lit(1)).alias("rows"), *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]]
    for i, c in enumerate(columns):
        if types[c] == "categorical":
            measures += [
                F.count_if(F.col(f"c{i}").rlike(NUMBER_PATTERN)).alias(f"num{i}"),
                F.count(F.col(f"c{i}").try_cast("timestamp")).alias(f"ts{i}"),
                F.count(f"d{i}_shape").alias(f"dates{i}"),
                F.min(f"d{i}_shape").alias(f"low{i}"), F.max(f"d{i}_shape").alias(f"high{i}"),
                F.bit_and(f"d{i}_orders").alias(f"orders{i}"),
            ]
    row = cells.agg(*measures)

    nothing, no_count, no_text = F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def measured(i: int, c: str) -> Column:
        text = types[c] == "categorical"
        return F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(spark_types[c]).alias("current_type"),
            F.lit(types[c]).alias("type"), F.col("rows").alias("total_count"), F.col(f"n{i}").alias("present"),
            *[(F.col(f"{m}{i}") if text else missing).alias(m) for m, missing in (
                ("num", no_count), ("ts", no_count), ("dates", no_count), ("low", no_text), ("high", no_text),
                ("orders", nothing))])

    present = F.col("present")
    date_format = F.when(present > 0, F.when(F.col("ts") == present, ISO).when(
        F.col("dates") == present, common_format(F.col("low"), F.col("high"), F.col("orders"))))
    inferred = F.when((present > 0) & (F.col("num") == present), "numeric_string").when(
        F.col("date_format").isNotNull(), "datetime_string").otherwise(F.col("type"))
    long = row.select(F.inline(F.array(*[measured(i, c) for i, c in enumerate(columns)])))
    return long.withColumn("date_format", date_format).withColumn("inferred_type", inferred).select(
        "position", "column", "current_type", "inferred_type",
        F.when(F.col("inferred_type") == "datetime_string", F.col("date_format")).alias("date_format"),
        "total_count", (F.col("total_count") - present).alias("missing_count"))


def type_report(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 5) -> DataFrame:
    """Deep typing with each column's distinct count and its ``samples`` smallest values as text.

    Types come from one scan, the rest from one value histogram; numbers sort as
    numbers. Columns without flat values have neither.
    """
    types = infer_types(df, columns)
    counts = value_counts(df, columns)
    numeric = F.col("column").isin(numeric_only(df, columns))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(
        F.when(numeric, F.col("value").try_cast("double")).asc_nulls_last(), "value"))
    first = counts.withColumn("rank", rank).filter(F.col("rank") <= samples).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values"))
    held = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    return types.join(held, "column", "left").join(first, "column", "left").withColumns({
        "distinct_count": F.coalesce("distinct_count", F.lit(0).cast("bigint")),
        "sample_values": F.coalesce("sample_values", F.array().cast("array<string>"))})


def potential_conversion() -> Column:
    return F.col("inferred_type").isin("numeric_string", "datetime_string")
