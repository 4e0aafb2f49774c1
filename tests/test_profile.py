import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab import schema
from veritab.functions.quantiles import exact_quantiles
from veritab.operators import characteristics, correlation, profile, quality, values

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_ten_row_statistics(ten):
    stats = by_column(profile.column_statistics(ten))
    first, mixed, text = stats["numeric_col"], stats["mixed_col"], stats["categorical_col"]
    assert (first["missing_count"], first["missing_percentage"], first["distinct_count"]) == (1, 10.0, 9)
    assert first["mean"] == pytest.approx(5.444444, abs=1e-6) and first["std"] == pytest.approx(3.205897, abs=1e-6)
    assert (first["q25"], first["median"], first["q75"]) == (3.0, 5.0, 8.0)
    assert (mixed["q25"], mixed["median"], mixed["q75"]) == (4.4, 6.6, 8.8)
    assert text["mean"] is None and text["distinct_count"] == 3
    summary = profile.dataset_missing_summary(profile.column_statistics(ten)).first()
    assert tuple(summary) == (2, 2, 6.67)


def test_ten_row_quality(ten):
    row = quality.quality_summary(ten).first()
    assert row["overall_quality_score"] == 91.7
    assert row["score_unrounded"] == pytest.approx(91.665)
    assert (row["total_missing"], row["total_missing_percentage"], row["duplicate_rows"]) == (2, 6.67, 0)
    only = quality.imbalance_by_column(ten).first()
    assert only["imbalance_ratio"] == 0.75
    assert only["entropy"] == pytest.approx(1.570951, abs=1e-6)
    assert only["normalized_entropy"] == pytest.approx(0.991159, abs=1e-6)
    assert correlation.correlation_pairs(ten).first()["correlation"] == pytest.approx(0.996157, abs=1e-6)


def test_outlier_bounds(ten):
    found = by_column(quality.outlier_counts(ten))
    assert (found["numeric_col"]["lower_bound"], found["numeric_col"]["upper_bound"]) == (-4.5, 15.5)
    assert found["mixed_col"]["lower_bound"] == pytest.approx(-2.2)
    assert found["mixed_col"]["upper_bound"] == pytest.approx(15.4)
    assert all(r["iqr_outliers"] == r["zscore_outliers"] == 0 for r in found.values())


def test_types(spark):
    df = spark.createDataFrame(
        [("1", "2020-01-01", None, "x", True), ("2.5", "2021-02-03 04:05:06", None, "1", False), (None, None, None, "2", True)],
        "number string, moment string, nothing string, mixed string, flag boolean")
    found = {r["column"]: r["inferred_type"] for r in profile.infer_types(df).collect()}
    assert found == {"number": "numeric_string", "moment": "datetime_string", "nothing": "categorical",
                     "mixed": "categorical", "flag": "boolean"}


def test_boolean_column(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (True,)], "flag boolean")
    row = profile.column_statistics(df).first()
    assert (row["data_type"], row["true_count"], row["false_count"], row["true_percentage"]) == ("boolean", 3, 1, 75.0)
    assert quality.outlier_counts(df).count() == 0
    assert schema.numeric_only(df) == [] and schema.numeric_or_bool(df) == ["flag"]


def test_one_row_and_no_values(spark):
    one = profile.column_statistics(spark.createDataFrame([(1.0,)], "x double")).first()
    assert one["std"] == 0.0
    none = profile.column_statistics(spark.createDataFrame([(None,), (None,)], "x double")).first()
    assert none["mean"] is None and none["missing_percentage"] == 100.0 and none["distinct_count"] == 0
    empty = profile.column_statistics(spark.createDataFrame([], "x double")).first()
    assert (empty["total_count"], empty["missing_percentage"]) == (0, 0.0)
    assert profile.preview_size(spark.createDataFrame([], "x double")).first()["rows_shown"] == 0


def test_nan_becomes_null(spark):
    df = schema.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert [r["x"] for r in df.orderBy("k").collect()] == [None, 2.0]


def test_duplicates_with_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", "y")], "id int, a string, b string")
    row = quality.duplicate_summary(df, ["a", "b"]).first()
    assert (row["duplicate_rows"], row["duplicate_groups"], row["unique_rows"]) == (1, 1, 2)
    assert [r[0] for r in quality.duplicate_keys(df, "id", ["a", "b"]).collect()] == [2]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, float(i), float(i * i)) for i in range(7)], "k double, x double, y double")
    found = {(r["column_1"], r["column_2"]): r["correlation"] for r in correlation.correlation_matrix(df).collect()}
    assert found["k", "k"] is None and found["k", "x"] is None
    assert found["x", "x"] == pytest.approx(1.0, abs=1e-10)
    assert found["x", "y"] == found["y", "x"]


def test_correlated_triple(spark):
    import numpy as np

    noise = np.random.default_rng(42)
    x, z = noise.normal(size=100), noise.normal(size=100)
    frame = pd.DataFrame({"x": x, "y": x + 0.1 * noise.normal(size=100), "z": z})
    pairs = correlation.highly_correlated(correlation.correlation_pairs(spark.createDataFrame(frame))).collect()
    assert [(p["column_1"], p["column_2"], p["strength"]) for p in pairs] == [("x", "y", "strong")]


def test_characteristics(spark):
    df = spark.createDataFrame(
        list(zip([1, 2, 3, 4, 5], [5, 4, 3, 2, 1], "ababa", [0, 1, 0, 1, 0])),
        "num1 int, num2 int, cat1 string, target int")
    row = characteristics.dataset_characteristics(df, "d").first()
    assert (row["numeric_columns"], row["categorical_columns"], row["size_class"]) == (3, 1, "small")
    assert row["has_high_correlation"] is True


def test_quantile_search_with_hot_values(spark):
    """More values than the buffer holds, a third of them equal: still the exact quantiles."""
    numbers = [7.25] * 400 + [float(i % 97) / 3 for i in range(500)] + [1e6 + i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.66, 0.75, 0.99, 1.0)
    want = pd.Series(numbers).quantile(list(probabilities)).tolist()
    assert exact_quantiles(df, ["x"], probabilities, buffer_rows=20)["x"] == pytest.approx(want)


def test_statistics_above_the_buffer(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    small = by_column(profile.column_statistics(df, ["l_extendedprice", "l_discount"]))
    large = by_column(profile.column_statistics(df, ["l_extendedprice", "l_discount"], buffer_rows=50))
    for c in small:
        assert [small[c][m] for m in ("q25", "median", "q75")] == pytest.approx(
            [large[c][m] for m in ("q25", "median", "q75")])


cells = st.one_of(st.none(), st.floats(-1000, 1000, allow_nan=False).map(lambda v: round(v, 3)))


@QUICK
@given(st.lists(st.tuples(cells, cells), min_size=5, max_size=40))
def test_statistics_like_pandas(spark, rows):
    frame = pd.DataFrame(rows, columns=["a", "b"], dtype=float)
    df = spark.createDataFrame(rows, "a double, b double")
    stats = by_column(profile.column_statistics(df))
    for c in "ab":
        assert stats[c]["missing_count"] == frame[c].isnull().sum()
        assert stats[c]["distinct_count"] == frame[c].nunique()
        for name, want in [("mean", frame[c].mean()), ("median", frame[c].median()), ("min", frame[c].min()),
                           ("max", frame[c].max()), ("q25", frame[c].quantile(0.25))]:
            assert stats[c][name] is None if math.isnan(want) else stats[c][name] == pytest.approx(want, abs=1e-6)
    score = quality.quality_summary(df).first()["overall_quality_score"]
    assert 0 <= score <= 100


def test_value_counts_is_one_shuffle_per_carrier(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = values.value_counts(df, ["l_returnflag", "l_linestatus"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_top_values_cut_before_the_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet")
    plan = values.top_values(df, ["p_name", "p_brand"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_it_needs(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = profile.column_statistics(df, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan and "l_shipdate" not in plan


def test_samples_and_top_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", None, "a", "b", "c", "a"])], "k int, x string")
    assert [r["value"] for r in values.sample_values(df, "x", "k", 3).collect()] == ["b", "a", "b"]
    top = values.top_values(df, ["x"], 2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == [("a", 2), ("b", 2)]
    approximate = values.distinct_counts(df, ["x"], exact=False).first()
    assert approximate["distinct_count"] == 3


def test_missing_bands(spark):
    df = spark.range(10).select(
        F.when(F.col("id") < 4, F.col("id")).alias("high"), F.when(F.col("id") < 8, F.col("id")).alias("moderate"),
        F.when(F.col("id") < 9, F.col("id")).alias("low"), F.col("id").alias("complete"))
    assert all(r["column"] == r["band"] for r in quality.missing_by_column(df).collect())


def test_frames_without_scalar_columns(spark):
    df = spark.createDataFrame([([1],)], "x array<int>")
    assert profile.column_statistics(df).count() == 0
    assert profile.infer_types(df, []).count() == 0 and quality.missing_by_column(df, []).count() == 0
