"""Cleaning operators.

Each one returns the transformed DataFrame, still lazy, and a dict of details.
What has to be learned from the data (means, bounds, categories) is a bounded
result of at most a few small jobs and enters the plan as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.quantiles import BUFFER_ROWS, exact_quantiles
from veritab.functions.ranking import BROADCAST_ROWS, BUCKET_ROWS, dense_codes, lookup
from veritab.operators.values import modes, value_counts
from veritab.schema import as_double, categorical, col, column_types, numeric_only, numeric_or_bool, require_columns

Step = tuple[DataFrame, dict[str, Any]]

# Fixed value: stands in for a missing category when codes are assigned.
MISSING_CATEGORY = "__MISSING__"


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)
    ]).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(columns)}


# --- missing values -------------------------------------------------------


def remove_nulls(
    df: DataFrame,
    method: str = "drop_rows",
    columns: Sequence[str] | None = None,
    threshold: float = 0.0,
) -> Step:
    """Drop rows with a NULL, named columns, or columns whose NULL share exceeds ``threshold``."""
    columns = list(columns or [])
    require_columns(df, columns)
    details = {"method_used": method, "columns_affected": columns or "all", "threshold_used": threshold}
    if method == "drop_rows":
        checked = columns or df.columns
        complete = reduce(lambda a, b: a & b, [col(c).isNotNull() for c in checked])
        removed = df.agg(F.count_if(~complete)).first()[0]
        return df.filter(complete), {**details, "rows_removed": removed, "columns_removed": 0}
    if method == "drop_columns":
        dropped = columns
        if not columns:
            rows, nulls = _null_counts(df, df.columns)
            dropped = [c for c in df.columns if rows and nulls[c] / rows > threshold]
        kept = [col(c) for c in df.columns if c not in dropped]
        return df.select(*kept), {**details, "rows_removed": 0, "columns_removed": len(dropped)}
    raise ValueError(f"Unknown null removal method: {method}")


def _constant(df: DataFrame, name: str, value: Any) -> Column:
    kind = column_types(df)[name]
    if kind == "integer" and isinstance(value, int) and not isinstance(value, bool):
        return F.coalesce(col(name), F.lit(value))
    if kind in ("integer", "float") and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(as_double(name), F.lit(float(value)))
    if kind == "boolean" and isinstance(value, bool):
        return F.coalesce(col(name), F.lit(value))
    return F.coalesce(col(name).cast("string"), F.lit(str(value)))


def fill_nulls(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    fill_value: Any = None,
    buffer_rows: int = BUFFER_ROWS,
) -> Step:
    """Fill NULLs with the mean, median, mode or a constant; columns without NULLs are left alone.

    Mean and median turn a filled integer column into double.
    """
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    _, nulls = _null_counts(df, wanted) if wanted else (0, {})
    with_nulls = [c for c in wanted if nulls[c] > 0]
    fills: dict[str, Column] = {}
    if strategy in ("mean", "median"):
        numeric = numeric_or_bool(df, with_nulls)
        if numeric and strategy == "mean":
            row = df.agg(*[F.avg(as_double(c)).alias(f"v{i}") for i, c in enumerate(numeric)]).first()
            values = {c: row[f"v{i}"] for i, c in enumerate(numeric)}
        else:
            values = {c: q[0] for c, q in exact_quantiles(df, numeric, (0.5,), buffer_rows).items()}
        fills = {c: F.coalesce(as_double(c), F.lit(v).cast("double")) for c, v in values.items()}
    elif strategy == "mode":
        for row in modes(df, with_nulls).collect() if with_nulls else []:
            data_type = df.schema[row["column"]].dataType
            fills[row["column"]] = F.coalesce(col(row["column"]), F.lit(row["value"]).cast(data_type))
    elif strategy == "constant" and fill_value is not None:
        fills = {c: _constant(df, c, fill_value) for c in with_nulls}
    affected = [c for c in wanted if c in fills]
    unfilled = {c for c in affected if strategy in ("mean", "median") and values[c] is None}
    return _replace(df, fills), {
        "strategy_used": strategy, "fill_value_used": fill_value, "columns_affected": affected,
        "total_nulls_filled": sum(nulls[c] for c in affected if c not in unfilled),
    }


# --- outliers -------------------------------------------------------------


def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    columns: Sequence[str] | None = None,
    threshold: float = 3.0,
    buffer_rows: int = BUFFER_ROWS,
) -> Step:
    """Drop rows that lie outside the bounds of any column; NULLs are never outliers.

    Bounds of every column come from the input, and one filter applies them all.
    """
    if method == "iqr":
        chosen = numeric_only(df, columns)
        quartiles = exact_quantiles(df, chosen, (0.25, 0.75), buffer_rows)
        masks = {}
        for c, (q1, q3) in quartiles.items():
            if q1 is not None:
                reach = threshold * (q3 - q1)
                masks[c] = (as_double(c) < q1 - reach) | (as_double(c) > q3 + reach)
    elif method == "zscore":
        chosen = numeric_or_bool(df, columns)
        masks = {}
        if chosen:
            row = df.agg(*[m for i, c in enumerate(chosen) for m in (
                F.avg(as_double(c)).alias(f"m{i}"), F.stddev_samp(as_double(c)).alias(f"s{i}"))]).first()
            for i, c in enumerate(chosen):
                if row[f"s{i}"]:
                    masks[c] = F.abs((as_double(c) - row[f"m{i}"]) / row[f"s{i}"]) > threshold
    else:
        raise ValueError(f"Unknown outlier detection method: {method}")
    details = {"method_used": method, "threshold_used": threshold, "columns_processed": chosen}
    if not masks:
        return df, {**details, "outliers_removed": 0, "rows_removed": 0}
    flags = [F.coalesce(mask, F.lit(False)) for mask in masks.values()]
    outlying = reduce(lambda a, b: a | b, flags)
    counted = df.agg(F.count_if(outlying).alias("rows"), *[
        F.count_if(flag).alias(f"n{i}") for i, flag in enumerate(flags)]).first()
    return df.filter(~outlying), {
        **details,
        "outliers_removed": sum(counted[f"n{i}"] for i in range(len(flags))),
        "rows_removed": counted["rows"],
    }


# --- scaling --------------------------------------------------------------


def fit_scaling(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, shift, divisor)`` per numeric column: mean and population deviation, or min and range.

    A constant column divides by 1.
    """
    if method not in ("standard", "minmax"):
        raise ValueError(f"Unknown scaling method: {method}")
    chosen = numeric_or_bool(df, columns)
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, shift double, divisor double")
    measures = []
    for i, c in enumerate(chosen):
        x = as_double(c)
        shift, spread = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
        measures += [shift.alias(f"shift{i}"), spread.alias(f"spread{i}")]
    return df.agg(*measures).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"shift{i}").alias("shift"),
                 F.when(F.col(f"spread{i}") == 0, 1.0).otherwise(F.col(f"spread{i}")).alias("divisor"))
        for i, c in enumerate(chosen)
    ])))


def apply_scaling(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Scale with fitted parameters; NULLs stay NULL."""
    fitted = {row["column"]: row for row in parameters.collect()}
    return _replace(df, {
        c: (as_double(c) - F.lit(p["shift"]).cast("double")) / F.lit(p["divisor"]).cast("double")
        for c, p in fitted.items()
    })


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> Step:
    parameters = fit_scaling(df, method, columns)
    rows = parameters.collect()
    fitted = df.sparkSession.createDataFrame(rows, parameters.schema)
    return apply_scaling(df, fitted), {
        "method_used": method, "columns_scaled": [r["column"] for r in rows],
        "scaler_parameters": {r["column"]: {"shift": r["shift"], "divisor": r["divisor"]} for r in rows},
    }


# --- encoding -------------------------------------------------------------


def label_mapping(
    df: DataFrame,
    column: str,
    placeholder_code: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(value, code, n)``: categories in ascending order, numbered from 0.

    With ``placeholder_code`` the missing-value placeholder takes its own
    place in the order whenever the column has NULLs.
    """
    require_columns(df, [column])
    counts = value_counts(df, [column]).select("value", "n")
    if placeholder_code:
        placeholder = (
            df.agg(F.count_if(col(column).isNull()).alias("n")).filter(F.col("n") > 0)
            .select(F.lit(MISSING_CATEGORY).alias("value"), "n")
        )
        counts = counts.unionByName(placeholder).groupBy("value").agg(F.sum("n").alias("n"))
    return dense_codes(counts, "value", "code", bucket_rows)


def label_encode(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    placeholder_code: bool = False,
    bucket_rows: int = BUCKET_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Step:
    """Replace text columns by their codes; NULLs stay NULL. Details hold the mapping DataFrames."""
    chosen = categorical(df, columns)
    mappings = {c: label_mapping(df, c, placeholder_code, bucket_rows) for c in chosen}
    encoded, order = df, df.columns
    for c, mapping in mappings.items():
        table = mapping.select(F.col("value").alias("_value"), F.col("code").alias("_code"), "n")
        encoded = lookup(encoded, c, table, "_value", "n", broadcast_rows)
        encoded = encoded.select(*[F.col("_code").alias(c) if name == c else col(name) for name in order])
    return encoded, {"columns_encoded": chosen, "mappings": mappings}


def one_hot_encode(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    drop_first: bool = False,
    form: str = "columns",
) -> Step:
    """One boolean column ``{column}_{value}`` per category, appended in order; the original is dropped.

    With ``form="vector"`` each column gets one sparse vector column
    ``{column}_vector`` instead, with the same slots in the same order. The form
    never depends on the data.
    """
    if form not in ("columns", "vector"):
        raise ValueError(f"form is columns or vector, not {form}")
    chosen = categorical(df, columns)
    added: list[Column] = []
    wide: list[str] = []
    created: dict[str, list[str]] = {}
    names: dict[str, list[str]] = {c: [] for c in chosen}
    if form == "vector":
        wide = list(chosen)
        created = {c: [f"{c}_vector"] for c in chosen}
    else:
        # All columns share one histogram.
        for row in value_counts(df, chosen).select("column", "value").collect():
            names[row["column"]].append(row["value"])
        for c in chosen:
            values = sorted(names[c], key=lambda v: v.encode())
            kept = values[1:] if drop_first else values
            created[c] = [f"{c}_{v}" for v in kept]
            added += [F.coalesce(col(c) == v, F.lit(False)).alias(f"{c}_{v}") for v in kept]
    encoded = df.select(*[col(c) for c in df.columns if c not in chosen or c in wide], *added)
    for c in wide:
        encoded = _one_hot_vector(encoded, df, c, drop_first)
    return encoded, {"columns_encoded": chosen, "new_columns": created, "drop_first": drop_first}


def _one_hot_vector(df: DataFrame, source: DataFrame, column: str, drop_first: bool) -> DataFrame:
    mapping = label_mapping(source, column)
    first = 1 if drop_first else 0
    slots = mapping.filter(F.col("code") >= first).select((F.col("code") - first).cast("double").alias("_slot"))
    size = slots.count()
    # The slot after the last one is the encoder's "invalid" slot, which it leaves all zero.
    encoder = OneHotEncoder(inputCol="_slot", outputCol=f"{column}_vector", handleInvalid="keep", dropLast=True)
    model = encoder.fit(slots.agg(F.max("_slot").alias("_slot")))
    table = mapping.select(F.col("value").alias("_value"), F.col("code").alias("_code"), "n")
    coded = lookup(df, column, table, "_value", "n")
    slot = F.when(F.col("_code") >= first, (F.col("_code") - first).cast("double")).otherwise(F.lit(float(size)))
    return model.transform(coded.withColumn("_slot", slot)).drop(column, "_code", "_slot")
