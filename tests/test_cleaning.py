import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions.ranking import dense_codes, lookup, running_totals
from veritab.operators import cleaning
from veritab.plans.cleaning import normalize, run_operations

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def column(df, name, key="k"):
    return [r[name] for r in df.orderBy(key).collect()]


def keyed(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}")


def test_nulls_survive_the_outlier_filter(spark):
    kept, details = cleaning.remove_outliers(keyed(spark, [1.0, 2.0, 3.0, 4.0, None, 100.0]), "iqr", ["x"], 1.5)
    assert column(kept, "x") == [1.0, 2.0, 3.0, 4.0, None]
    assert details["outliers_removed"] == details["rows_removed"] == 1


def test_row_outlying_twice_counts_twice(spark):
    rows = [(i, float(i), float(i)) for i in range(7)] + [(7, 500.0, 500.0)]
    kept, details = cleaning.remove_outliers(spark.createDataFrame(rows, "k int, x double, y double"), "iqr", ["x", "y"])
    assert kept.count() == 7
    assert (details["outliers_removed"], details["rows_removed"]) == (2, 1)


def test_constant_column(spark):
    df = keyed(spark, [1.0, 1.0, 1.0])
    assert cleaning.remove_outliers(df, "zscore", ["x"])[0].count() == 3
    for method in ("standard", "minmax"):
        assert column(cleaning.scale(df, method, ["x"])[0], "x") == [0.0, 0.0, 0.0]


def test_mean_fill_keeps_fractions(spark):
    done, details = cleaning.fill_nulls(keyed(spark, [1, None, 4], "int"), "mean", ["x"])
    assert column(done, "x") == [1.0, 2.5, 4.0]
    assert details["total_nulls_filled"] == 1 and details["columns_affected"] == ["x"]


def test_other_fills(spark):
    assert column(cleaning.fill_nulls(keyed(spark, ["b", "a", "a", "b", None], "string"), "mode")[0], "x")[-1] == "a"
    assert column(cleaning.fill_nulls(keyed(spark, [10, 9, 9, 10, None], "int"), "mode")[0], "x")[-1] == 9
    assert column(cleaning.fill_nulls(keyed(spark, [1.0, None, 2.0, 9.0]), "median")[0], "x")[1] == 2.0
    assert column(cleaning.fill_nulls(keyed(spark, [1, None], "int"), "constant", fill_value=5)[0], "x") == [1, 5]
    assert column(cleaning.fill_nulls(keyed(spark, [1, None], "int"), "constant", fill_value="U")[0], "x") == ["1", "U"]
    untouched, details = cleaning.fill_nulls(keyed(spark, [1, None], "int"), "constant")
    assert column(untouched, "x") == [1, None] and details["columns_affected"] == []


def test_null_removal(ten):
    assert cleaning.remove_nulls(ten)[0].count() == 8
    assert cleaning.remove_nulls(ten, columns=["mixed_col"])[1]["rows_removed"] == 1
    assert cleaning.remove_nulls(ten, "drop_columns")[0].columns == ["categorical_col"]
    assert len(cleaning.remove_nulls(ten, "drop_columns", threshold=0.1)[0].columns) == 3
    with pytest.raises(ValueError):
        cleaning.remove_nulls(ten, columns=["nope"])
    with pytest.raises(ValueError):
        cleaning.remove_nulls(ten, "nope")


def test_label_codes(spark):
    df = keyed(spark, ["b", "a", None], "string")
    assert column(cleaning.label_encode(df)[0], "x") == [1, 0, None]
    assert column(cleaning.label_encode(df, placeholder_code=True)[0], "x") == [2, 1, None]


def test_one_hot(spark):
    df = keyed(spark, ["a", None, "b"], "string")
    done, _ = cleaning.one_hot_encode(df)
    assert done.columns == ["k", "x_a", "x_b"]
    assert [tuple(r)[1:] for r in done.orderBy("k").collect()] == [(True, False), (False, False), (False, True)]
    wide, _ = cleaning.one_hot_encode(df, form="vector")
    assert [v.toArray().tolist() for v in column(wide, "x_vector")] == [[1, 0], [0, 0], [0, 1]]
    first, _ = cleaning.one_hot_encode(df, form="vector", drop_first=True)
    assert [v.toArray().tolist() for v in column(first, "x_vector")] == [[0], [0], [1]]


def test_ten_row_encoding(ten):
    done, _ = cleaning.one_hot_encode(ten)
    sums = done.agg(*[F.sum(F.col(f"categorical_col_{v}").cast("int")) for v in "ABC"]).first()
    assert tuple(sums) == (4, 3, 3)


def test_lookup_with_hot_keys(spark):
    """A third of the rows share one key and some have none; every path gives the same rows."""
    values = ["hot"] * 400 + [f"v{i % 200:03d}" for i in range(700)] + [None] * 100
    df = keyed(spark, values, "string")
    names = sorted({v for v in values if v})
    want = [names.index(v) if v else None for v in values]
    assert column(cleaning.label_encode(df, broadcast_rows=10)[0], "x") == want
    assert column(cleaning.label_encode(df, bucket_rows=30, broadcast_rows=10)[0], "x") == want
    table = df.filter("x is not null").groupBy("x").count().withColumn("one", F.lit(1)).withColumnRenamed("x", "y")
    assert lookup(df, "x", table, "y", "count", 10).agg(F.count("one"), F.count("*")).first() == (1100, 1200)


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 5).alias("w"))
    for descending in (False, True):
        got = running_totals(df, "v", {"t": "w"}, descending, bucket_rows=40)
        frame = df.toPandas().sort_values("v", ascending=not descending)
        want = dict(zip(frame["v"], frame["w"].cumsum()))
        assert {r["v"]: r["t"] for r in got.collect()} == want
    codes = dense_codes(df.select("v"), "v", "c", bucket_rows=3)
    assert codes.filter("v <> c").count() == 0


def test_chain_isolates_failures(ten):
    result = run_operations(ten, [
        {"operation": "handle_missing", "method": "fill", "columns": []},
        {"operation": "nonsense"},
        {"type": "null_removal", "parameters": {"method": "drop_columns", "columns": ["nope"]}},
        {"operation": "scale_features", "columns": ["numeric_col"]},
        {"operation": "encode_categorical", "method": "onehot"},
    ], "s1")
    assert [e["status"] for e in result.log] == ["completed", "failed", "failed", "completed", "completed"]
    assert (result.completed, result.failed) == (3, 2)
    assert result.log[0]["rows_before"] == 10 and result.log[-1]["columns_after"] == 5
    assert all({"session_id", "timestamp", "action", "parameters", "duration_ms"} <= set(e) for e in result.log)
    means = result.data.agg(F.avg("numeric_col"), F.stddev_pop("numeric_col")).first()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(1)


def test_normal_forms():
    assert normalize({"operation": "handle_missing", "method": "drop", "columns": ["a"]}) == {
        "type": "null_removal", "parameters": {"method": "drop_rows", "columns": ["a"]}}
    assert normalize({"operation": "detect_outliers"})["parameters"]["method"] == "iqr"
    assert normalize({"operation": "encode_categorical", "method": "label"})["type"] == "label_encoding"
    whole = {"type": "scaling", "parameters": {"method": "minmax"}}
    assert normalize(whole) is whole


@QUICK
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False).map(lambda v: round(v, 2))),
                min_size=4, max_size=40).filter(lambda v: len({x for x in v if x is not None}) > 1))
def test_scaling_properties(spark, values):
    df = keyed(spark, values)
    want = pd.Series(values, dtype=float)
    standard = np.array([v for v in column(cleaning.scale(df, "standard", ["x"])[0], "x") if v is not None])
    assert standard.mean() == pytest.approx(0, abs=1e-6) and standard.std() == pytest.approx(1, abs=1e-6)
    ranged = [v for v in column(cleaning.scale(df, "minmax", ["x"])[0], "x") if v is not None]
    assert min(ranged) == 0.0 and max(ranged) == pytest.approx(1.0)
    filled = column(cleaning.fill_nulls(df, "mean", ["x"])[0], "x")
    assert filled == pytest.approx(want.fillna(want.mean()).tolist())


@QUICK
@given(st.lists(st.one_of(st.none(), st.sampled_from(["red", "Blue", "é", "", "z z"])), min_size=1, max_size=30))
def test_encoding_properties(spark, values):
    df = keyed(spark, values, "string")
    codes = column(cleaning.label_encode(df)[0], "x")
    names = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert codes == [names.index(v) if v is not None else None for v in values]
    flags = cleaning.one_hot_encode(df)[0].drop("k").collect()
    assert all(sum(r) <= 1 for r in flags)


def test_outlier_filter_has_no_join_or_shuffle(spark, data):
    kept, _ = cleaning.remove_outliers(spark.read.parquet(f"{data}/events.parquet"), "iqr", ["value"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "PushedFilters" in plan


def test_lookup_by_array_key(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 100, F.array(F.lit(0), F.lit(0))).otherwise(
        F.array(F.col("id"), F.lit(1))).cast("array<bigint>").alias("cell"))
    table = df.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    for limit in (1000, 1):
        got = lookup(df, "cell", table, "c", "n", limit)
        assert got.filter(F.col("first") != F.when(F.col("id") < 100, 0).otherwise(F.col("id"))).count() == 0
        assert got.count() == got.filter("first is not null").count() == 300
