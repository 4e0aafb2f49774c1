"""Date formats, the type report, imbalance from one histogram, and cells that do not fit a schema."""

import math
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.numeric import from_log_number, log_number
from veritab.operators import profile, quality
from veritab.sources.readers import DatasetError, read_csv

DAYS = [date(2023, 1, 1) + timedelta(days=17 * i) for i in range(30)]


def typed(spark, values):
    row = profile.infer_types(spark.createDataFrame([(v,) for v in values], "x string")).first()
    return row["inferred_type"], row["date_format"]


@pytest.mark.parametrize("written,named", [
    ("%m/%d/%Y", "M/d/yyyy"), ("%d/%m/%Y", "d/M/yyyy"), ("%d.%m.%Y", "d.M.yyyy"), ("%m-%d-%y", "M-d-yy"),
    ("%Y/%m/%d", "yyyy/M/d"), ("%Y-%m-%d", "ISO"), ("%d/%m/%Y 23:59:59", "d/M/yyyy H:mm:ss"), ("%d %b %Y", "d MMM yyyy"),
    ("%B %d, %Y", "MMM d, yyyy"), ("%m/%d/%Y 11:05 PM", "M/d/yyyy h:mm a"), ("%m/%d/%Y 11:05pm", "M/d/yyyy h:mm a"),
    ("%m/%d/%Y 01:02:03.25", "M/d/yyyy H:mm:ss.S"), ("%Y-%m-%dT10:00:00Z", "ISO"), ("  %m/%d/%Y ", "M/d/yyyy"),
])
def test_one_format_for_all_values(spark, written, named):
    assert typed(spark, [d.strftime(written) for d in DAYS] + [None]) == ("datetime_string", named)


@pytest.mark.parametrize("values", [
    ["12/31/2023", "31/12/2023"], ["12/31/2023", "12-31-2023"], ["02/30/2023"], ["02/29/2023"], ["13/13/2023"],
    ["12/31/2023 24:00"], ["12/31/2023 13:00 PM"], ["12/31/2023", "12/31/2023 10:00"], ["a/b/Y"], ["Y/5/5"], ["12/31/2023", ""],
    ["Mai 5, 2023"], ["1/2/3/4"], ["12/31/20234"], ["x" * 50],
])
def test_no_common_format(spark, values):
    assert typed(spark, values) == ("categorical", None)


def test_ambiguous_dates_put_the_month_first(spark):
    assert typed(spark, ["1/2/2023", "3/4/2023"]) == ("datetime_string", "M/d/yyyy")
    assert typed(spark, ["1/2/2023", "3/14/2023"]) == ("datetime_string", "M/d/yyyy")
    assert typed(spark, ["1/2/2023", "13/4/2023"]) == ("datetime_string", "d/M/yyyy")
    assert typed(spark, ["02/29/2024", "2/28/2023"]) == ("datetime_string", "M/d/yyyy")
    assert typed(spark, [None, None]) == ("categorical", None)


def test_quality_score_follows_the_types(spark):
    rows = [(i, d.strftime("%m/%d/%Y")) for i, d in enumerate(DAYS)]
    row = quality.quality_summary(spark.createDataFrame(rows, "k int, day string")).first()
    assert row["potential_conversions"] == ["day"]


def test_type_report(spark):
    df = spark.createDataFrame([(i % 12, "ab"[i % 2] if i % 5 else None, [i]) for i in range(40)], "n int, s string, a array<int>")
    found = {r["column"]: r for r in profile.type_report(df).collect()}
    assert found["n"]["sample_values"] == ["0", "1", "2", "3", "4"] and found["n"]["distinct_count"] == 12
    assert found["s"]["sample_values"] == ["a", "b"] and found["s"]["missing_count"] == 8
    assert found["a"]["sample_values"] == [] and found["a"]["distinct_count"] == 0


def test_imbalance_against_plain_counting(spark):
    values = [f"v{int(i ** 0.6)}" for i in range(2000)] + [None] * 5 + ["é", "z", "Z"]
    df = spark.createDataFrame([(v, "same", i % 2 == 0) for i, v in enumerate(values)], "x string, one string, b boolean")
    found = {r["column"]: r for r in quality.imbalance_by_column(df.repartition(7)).collect()}
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    row = found["x"]
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))
    assert set(found) == {"x"} and row["unique_values"] == len(counts)
    assert [(v["value"], v["n"]) for v in row["value_distribution"]] == order[:10]
    assert (row["most_frequent_value"], row["least_frequent_value"]) == (order[0][0], order[-1][0])
    assert row["entropy"] == pytest.approx(-sum(n / total * math.log2(n / total + 1e-10) for n in counts.values()))


def test_imbalance_plans_its_histogram_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 7).cast("string").alias("s"), (F.col("id") % 2 == 0).alias("b")).write.parquet(
        str(tmp_path / "t"))
    plan = quality.imbalance_by_column(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_cells_that_do_not_fit_the_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2.5,x\nno,3,y\n3,,z\noops,NA,w\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    with pytest.raises(DatasetError, match="2 in a .bigint., for example 'no'"):
        read_csv(spark, str(tmp_path / "t.csv"), schema=schema)
    text = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    assert [r["b"] for r in read_csv(spark, str(tmp_path / "t.csv"), schema=text).collect()] == [2.5, 3.0, None, None]


def test_log_numbers_of_any_size(spark):
    df = spark.createDataFrame([(1e30,), (-2.5e300,), (1e15,), (0.1 + 0.2,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(from_log_number(log_number(F.col("x")))).collect()] == [
        1e30, -2.5e300, 1e15, 0.3, None, None]
