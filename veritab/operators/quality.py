"""Quality analyses and the overall score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.functions.numeric import percent
from veritab.functions.quantiles import BUFFER_ROWS, exact_quantiles
from veritab.functions.ranking import BROADCAST_ROWS
from veritab.operators.profile import infer_types, potential_conversion
from veritab.operators.values import value_counts
from veritab.schema import as_double, col, column_types, numeric_only, require_columns, scalar_columns
from veritab.session import checkpoint

REPORT_IQR_FACTOR = 1.5
REPORT_Z_LIMIT = 3.0


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column with their band: high above 50 %, moderate above 10 %."""
    columns = df.columns if columns is None else list(columns)
    require_columns(df, columns)
    if not columns:
        nothing = df.sparkSession.createDataFrame([], "none string")
        return missing_by_column(nothing).filter(F.lit(False))
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    long = wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.col("rows").alias("total_count"),
            F.col(f"m{i}").alias("missing_count"),
            percent(F.col(f"m{i}"), F.col("rows")).alias("missing_percentage"),
        ) for i, c in enumerate(columns)
    ])))
    return long.withColumn("band", missing_band(F.col("missing_count"), F.col("missing_percentage")))


def missing_band(count: Column, percentage: Column) -> Column:
    return (
        F.when(count == 0, "complete").when(percentage > 50, "high").when(percentage > 10, "moderate").otherwise("low")
    )


def _fingerprints(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits that equal rows share; NULLs are equal and differ from all values."""
    cells = [x for c in columns for x in (col(c), col(c).isNull())]
    return [F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in enumerate(_PRINTS)]


_PRINTS = ("fingerprint_1", "fingerprint_2")


def _held_twice(df: DataFrame, columns: Sequence[str], key: str | None = None) -> tuple[int, DataFrame]:
    """Rows whose fingerprint nothing else has, and the others as ``cell_0, cell_1, ...`` and ``key``.

    Only fingerprints are shuffled for all rows, and those held twice are written.
    Whole rows move where their fingerprint is among them: a table of checked size
    is sent to all tasks, a larger one meets the rows in a shuffle.
    """
    counted = df.select(*_fingerprints(df, columns)).groupBy(*_PRINTS).agg(F.count(F.lit(1)).alias("n"))
    shared = checkpoint(counted.filter("n > 1"))
    prints, rows = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = shared.select(*_PRINTS)
    carried = [] if key is None else [col(key).alias("key")]
    cells = df.select(
        *_fingerprints(df, columns), *[col(c).alias(f"cell_{i}") for i, c in enumerate(columns)], *carried)
    return df.count() - rows, cells.join(
        F.broadcast(shared) if prints <= BROADCAST_ROWS else shared, list(_PRINTS), "left_semi")


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Duplicate rows (all but the first copy; NULLs are equal), groups and unique rows.

    Rows are counted by fingerprint, and only those that share one are compared.
    Copies collapse in the partial aggregates, so a row that fills a third of the
    table costs one shuffled row per task.
    """
    columns = df.columns if columns is None else list(columns)
    require_columns(df, columns)
    if not columns:
        return duplicate_summary(df.select(F.lit(0).alias("none")), ["none"])
    alone, suspects = _held_twice(df, columns)
    groups = suspects.groupBy(*_PRINTS, *[f"cell_{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + alone).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        (F.count(F.lit(1)) + alone).alias("unique_rows"),
    )
    return totals.select(
        "total_rows", "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"),
        "unique_rows", "duplicate_groups", (F.col("duplicate_rows") > 0).alias("has_duplicates"),
    )


def duplicate_keys(df: DataFrame, key: str, columns: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """The smallest ``limit`` keys of rows that repeat an earlier row.

    Only rows whose fingerprint is held twice are compared. Each group contributes
    at most ``limit + 1`` rows, cut before the shuffle by the window's group limit.
    """
    columns = [c for c in df.columns if c != key] if columns is None else list(columns)
    require_columns(df, [key, *columns])
    if not columns:
        return duplicate_keys(df.select(col(key), F.lit(0).alias(f"{key}_")), key, [f"{key}_"], limit)
    _, suspects = _held_twice(df, columns, key)
    window = Window.partitionBy(*_PRINTS, *[f"cell_{i}" for i in range(len(columns))]).orderBy("key")
    return (
        suspects.withColumn("copy", F.row_number().over(window))
        .filter(F.col("copy") <= limit + 1)
        .filter(F.col("copy") > 1)
        .select(F.col("key").alias(key)).orderBy(col(key)).limit(limit)
    )


def _non_numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    types = column_types(df)
    return [c for c in scalar_columns(df, columns) if types[c] in ("categorical", "datetime")]


def _imbalance_band(rounded_ratio: Column) -> Column:
    return F.when(rounded_ratio < 0.1, "severe").when(rounded_ratio < 0.3, "moderate").otherwise("balanced")


def imbalance_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, ratio_unrounded, band)``: least to most frequent value, for columns with at least two values."""
    found = value_counts(df, _non_numeric(df, columns)).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), (F.min("n") / F.max("n")).alias("ratio_unrounded"))
    return found.filter(F.col("unique_values") > 1).select(
        "column", "ratio_unrounded", _imbalance_band(F.bround("ratio_unrounded", 3)).alias("band"))


def imbalance_by_column(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """Imbalance of every non-numeric column that has at least two values.

    One pass over the value histogram serves everything: each task reduces its
    part of a column to how many values occur how often (few numbers, as they add
    up to the rows), its rarest value and its ``top`` most frequent ones, and these
    are merged. ``value_distribution`` lists the most frequent values with their
    counts, ties by ascending value.
    """
    counts = value_counts(df, _non_numeric(df, columns))
    schema = "column string, values array<bigint>, times array<bigint>, top array<struct<value: string, n: bigint>>, " \
             "rare struct<value: string, n: bigint>"

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, ValueSummary] = {}
        for batch in batches:
            for name in pc.unique(batch.column("column")).to_pylist():
                part = batch.filter(pc.equal(batch.column("column"), name))
                held.setdefault(name, ValueSummary(top)).add(part.column("value"), part.column("n").to_numpy())
        if held:
            yield pa.RecordBatch.from_pylist([{"column": c, **s.state()} for c, s in held.items()], _SUMMARY)

    def merged(group: pa.Table) -> pa.Table:
        whole = ValueSummary(top)
        for state in group.to_pylist():
            whole.merge(state)
        return pa.Table.from_pylist([{"column": group["column"][0].as_py(), **whole.state()}], _SUMMARY)

    summary = counts.mapInArrow(reduced, schema).groupBy("column").applyInArrow(merged, schema)
    total = F.aggregate(F.zip_with("values", "times", lambda v, t: v * t), F.lit(0).cast("bigint"), lambda s, x: s + x)
    terms = F.zip_with("values", "times", lambda v, t: t * (v / F.col("total")) * F.log2(v / F.col("total") + F.lit(1e-10)))
    per_column = summary.withColumn("total", total).select(
        "column",
        F.aggregate("times", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("unique_values"),
        (-F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).alias("entropy"),
        F.col("top")[0]["value"].alias("most_frequent_value"), F.col("top")[0]["n"].alias("most_frequent_count"),
        F.col("rare.value").alias("least_frequent_value"), F.col("rare.n").alias("least_frequent_count"),
        F.col("top").alias("value_distribution"),
    ).filter(F.col("unique_values") > 1)
    ratio = F.col("least_frequent_count") / F.col("most_frequent_count")
    rounded = F.bround(ratio, 3)
    return per_column.select(
        "column", "unique_values",
        ratio.alias("ratio_unrounded"),
        rounded.alias("imbalance_ratio"),
        F.col("entropy"),
        (F.col("entropy") / F.log2(F.col("unique_values"))).alias("normalized_entropy"),
        "most_frequent_value", "most_frequent_count", "least_frequent_value", "least_frequent_count",
        _imbalance_band(rounded).alias("band"), "value_distribution",
    )


_VALUE = pa.struct([("value", pa.string()), ("n", pa.int64())])
_SUMMARY = pa.schema([("column", pa.string()), ("values", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
                      ("top", pa.list_(_VALUE)), ("rare", _VALUE)])


class ValueSummary:
    """How many values occur how often, the rarest value and the most frequent ones, of a part of a histogram."""

    def __init__(self, top: int):
        self.most, self.times, self.top, self.rare = top, Counter(), [], None

    def add(self, values: pa.Array, counts: np.ndarray) -> None:
        found, times = np.unique(counts, return_counts=True)
        # The bounds are kept by count first, so only the values at the ends are looked at.
        least = values.filter(pa.array(counts == found[0])).to_pylist()
        bound = np.partition(counts, -self.most)[-self.most] if len(counts) > self.most else found[0]
        above = pa.array(counts > bound)
        ties = sorted(values.filter(pa.array(counts == bound)).to_pylist(), key=_order)[:self.most]
        self._merge(dict(zip(found.tolist(), times.tolist())), [
            *zip(values.filter(above).to_pylist(), counts[counts > bound].tolist()), *((v, int(bound)) for v in ties)],
            (max(least, key=_order), int(found[0])))

    def merge(self, state: dict) -> None:
        self._merge(dict(zip(state["values"], state["times"])), [(x["value"], x["n"]) for x in state["top"]],
                    (state["rare"]["value"], state["rare"]["n"]))

    def _merge(self, times: dict[int, int], top: list[tuple[str, int]], rare: tuple[str, int]) -> None:
        self.times.update(times)
        self.top = sorted([*self.top, *top], key=lambda x: (-x[1], _order(x[0])))[:self.most]
        if self.rare is None or rare[1] < self.rare[1] or (
                rare[1] == self.rare[1] and _order(rare[0]) > _order(self.rare[0])):
            self.rare = rare

    def state(self) -> dict:
        values = sorted(self.times)
        return {"values": values, "times": [self.times[v] for v in values],
                "top": [{"value": v, "n": n} for v, n in self.top], "rare": {"value": self.rare[0], "n": self.rare[1]}}


def _order(value: str) -> bytes:
    """Texts compare by their bytes, as they do in Spark."""
    return value.encode()


def outlier_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """IQR and z-score outliers per numeric column that has values."""
    columns = numeric_only(df, columns)
    schema = ("position int, column string, value_count bigint, iqr_outliers bigint, iqr_outlier_percentage double, "
              "zscore_outliers bigint, zscore_outlier_percentage double, lower_bound double, upper_bound double, "
              "mean double, std double, min double, max double")
    moments = {}
    if columns:
        row = df.agg(*[
            m for i, c in enumerate(columns) for m in (
                F.count(as_double(c)).alias(f"n{i}"), F.avg(as_double(c)).alias(f"mean{i}"),
                F.stddev_samp(as_double(c)).alias(f"std{i}"))
        ]).first()
        moments = {c: (row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"]) for i, c in enumerate(columns)}
    columns = [c for c in columns if moments[c][0] > 0]
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    bounds = exact_quantiles(df, columns, (0.25, 0.75), buffer_rows)
    measures, limits = [], []
    for i, c in enumerate(columns):
        x = as_double(c)
        q1, q3 = bounds[c]
        low, high = q1 - REPORT_IQR_FACTOR * (q3 - q1), q3 + REPORT_IQR_FACTOR * (q3 - q1)
        _, mean, std = moments[c]
        limits.append((low, high, mean, std))
        far = F.abs((x - F.lit(mean)) / F.lit(std)) > REPORT_Z_LIMIT if std else F.lit(False)
        measures += [
            F.count(x).alias(f"n{i}"), F.count_if((x < low) | (x > high)).alias(f"iqr{i}"),
            F.count_if(far).alias(f"z{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
        ]
    return df.agg(*measures).select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("value_count"),
            F.col(f"iqr{i}").alias("iqr_outliers"),
            percent(F.col(f"iqr{i}"), F.col(f"n{i}")).alias("iqr_outlier_percentage"),
            F.col(f"z{i}").alias("zscore_outliers"),
            percent(F.col(f"z{i}"), F.col(f"n{i}")).alias("zscore_outlier_percentage"),
            F.lit(limits[i][0]).alias("lower_bound"), F.lit(limits[i][1]).alias("upper_bound"),
            F.lit(limits[i][2]).alias("mean"), F.lit(limits[i][3]).cast("double").alias("std"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
        ) for i, c in enumerate(columns)
    ])))


def quality_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """One row with every dataset-level measure and the overall score from 0 to 100.

    Each analysis contributes named columns of a single row; the rows are put
    together by one aggregate over their union, so nothing is joined.
    """
    df = df if columns is None else df.select(*[col(c) for c in columns])
    width = len(df.columns)

    def ordered(keep: Column) -> Column:
        """Names of the columns to keep, in table order."""
        return F.transform(
            F.array_sort(F.collect_list(F.when(keep, F.struct("position", "column")))), lambda s: s["column"])

    # Missing cells and text coverage come from one scan.
    share = percent(F.col("missing_count"), F.col("total_count"))
    columns_seen = infer_types(df).agg(
        F.max("total_count").alias("total_rows"),
        F.sum("missing_count").alias("total_missing"),
        percent(F.sum("missing_count"), F.sum("total_count")).alias("total_missing_percentage"),
        ordered(missing_band(F.col("missing_count"), share) == "high").alias("high_missing_columns"),
        ordered(potential_conversion()).alias("potential_conversions"),
    )
    duplicates = duplicate_summary(df, scalar_columns(df)).select(
        "duplicate_rows", "duplicate_percentage", "duplicate_groups")
    imbalance = imbalance_ratios(df).agg(
        F.bround(F.coalesce(F.avg("ratio_unrounded"), F.lit(1.0)), 3).alias("overall_imbalance_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("band") == "severe", F.col("column"))))
        .alias("severely_imbalanced_columns"),
        F.array_sort(F.collect_list(F.when(F.col("band") == "moderate", F.col("column"))))
        .alias("moderately_imbalanced_columns"),
    )
    outliers = outlier_counts(df, buffer_rows=buffer_rows).agg(
        F.avg("iqr_outlier_percentage").alias("average_outlier_percentage"),
        ordered(F.col("iqr_outlier_percentage") > 10).alias("columns_with_many_outliers"),
    )

    parts = [columns_seen, duplicates, imbalance, outliers]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part, allowMissingColumns=True)
    summary = joined.agg(*[F.first(c, ignorenulls=True).alias(c) for c in joined.columns])
    return summary.withColumn("total_columns", F.lit(width)).withColumn(
        "score_unrounded", quality_score(
            F.col("total_missing_percentage"), F.col("duplicate_percentage"), F.col("overall_imbalance_ratio"),
            F.col("average_outlier_percentage"), F.size("potential_conversions"), F.lit(width),
        )).withColumn("overall_quality_score", F.bround("score_unrounded", 1))


def quality_score(
    missing_percentage: Column,
    duplicate_percentage: Column,
    imbalance_ratio: Column,
    outlier_percentage: Column,
    conversions: Column,
    columns: Column,
) -> Column:
    """Weighted score: missing 25, duplicates 20, imbalance 20, outliers 15, types 20.

    A NULL outlier percentage (no numeric column) counts as no outliers.
    """
    zero = F.lit(0.0)
    return (
        F.greatest(zero, 100 - missing_percentage * 2) * 0.25
        + F.greatest(zero, 100 - duplicate_percentage * 3) * 0.20
        + imbalance_ratio * 100 * 0.20
        + F.coalesce(F.greatest(zero, 100 - outlier_percentage * 2), F.lit(100.0)) * 0.15
        + (1 - F.coalesce(F.try_divide(conversions, columns), zero)) * 100 * 0.20
    )
