from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritab.functions.numeric import log_number
from veritab.functions.text import parse_responses, text_hash
from veritab.operators import characteristics, pii, quality
from veritab.operators import recommendations as rules
from veritab.session import scratch_folder
from veritab.sources import datasets, readers, registry

NOON = datetime(2024, 5, 1, 12)


def write_text(spark, text, name="data.csv"):
    path = f"{scratch_folder(spark)}-{name}"
    with open(path.removeprefix("file:"), "w") as f:
        f.write(text)
    return path


def test_csv_types_and_missing_values(spark):
    path = write_text(spark, 'i,f,b,t,n\n1,1.5,True,"a, ""b""",NA\n,nan,false,x,\n3,2e3,TRUE,N/A,null\n')
    df = readers.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, 'a, "b"', None), (None, None, False, "x", None), (3, 2000.0, True, None, None)]


def test_csv_gates(spark):
    with pytest.raises(readers.DatasetError):
        readers.read_csv(spark, "data.parquet")
    with pytest.raises(readers.DatasetError, match="multi_line"):
        readers.read_csv(spark, write_text(spark, 'a,b\n1,2\n3,"x\ny"\n'))
    broken = readers.read_csv(spark, write_text(spark, 'a,b\n1,2\n3,"x\ny"\n'), multi_line=True)
    assert [r["b"] for r in broken.collect()] == ["2", "x\ny"]
    with pytest.raises(readers.DatasetError):
        readers.read_csv(spark, write_text(spark, "a,b\n1,2,3\n"))


def test_versions(spark):
    root = scratch_folder(spark)
    datasets.write_version(spark.range(3).toDF("x"), root, "s", "original")
    assert datasets.load_version(spark, root, "s").count() == 3
    with pytest.raises(readers.DatasetError):
        datasets.load_version(spark, root, "s", fallback=False)
    datasets.write_version(spark.range(2).toDF("x"), root, "s", "processed")
    assert datasets.load_version(spark, root, "s").count() == 2
    with pytest.raises(readers.DatasetError):
        datasets.load_version(spark, root, "other")


def test_size_limits(spark):
    df = spark.range(11).withColumn("b", F.lit(1))
    assert readers.size_violation(df) is None
    assert readers.size_violation(df, 60 * 1024 * 1024) == "File size (60.0 MB) exceeds maximum allowed size (50 MB)"
    tight = {"max_file_size_mb": 50, "max_rows": 10, "max_columns": 1}
    assert readers.size_violation(df, limits=tight) == "Row count (11) exceeds maximum allowed (10 rows)"
    assert readers.size_violation(df.limit(5), limits=tight).startswith("Column count (2)")


def test_log_roundtrip(spark):
    path = scratch_folder(spark)
    entries = [
        {"session_id": "s", "timestamp": NOON + timedelta(minutes=i), "operation_type": "training",
         "model_type": "supervised", "operation_id": "o", "status": status, "parameters": {"k": 5},
         "details": {"accuracy": 0.5}, "error": "broken" if status == "failed" else None}
        for i, status in enumerate(["training", "failed", "completed"])
    ]
    registry.append_log(registry.log_frame(spark, entries), path)
    log = spark.read.parquet(path)
    assert log.count() == 3
    assert registry.latest_operation(log).first()["status"] == "completed"
    row = registry.operation_status(log).first()
    assert row["status"] == "completed" and "accuracy" in row["results"] and row["error"] is None
    assert registry.operation_status(log.filter("status <> 'completed'")).first()["error"] == "broken"
    assert registry.newest_rows(log, "session_id", "timestamp", 2).count() == 2


def test_sessions(spark):
    path = scratch_folder(spark)
    registry.upsert_session(registry.session_frame(spark, [
        {"session_id": "s", "updated_at": NOON, "original_path": "o", "row_count": 5}]), path)
    registry.upsert_session(registry.session_frame(spark, [
        {"session_id": "s", "updated_at": NOON + timedelta(hours=1), "processed_path": "p", "quality_score": 91.7}]), path)
    row = registry.current_sessions(spark.read.parquet(path)).first()
    assert (row["original_path"], row["row_count"], row["quality_score"], row["dataset_path"]) == ("o", 5, 91.7, "p")


def test_cache(spark):
    cache = spark.createDataFrame(
        [("a", NOON - timedelta(hours=24), "edge"), ("b", NOON - timedelta(hours=25), "old"), ("a", NOON - timedelta(
            hours=30), "older")], "prompt_hash string, stored timestamp, response string")
    requests = spark.createDataFrame([(h,) for h in "aabc"], "prompt_hash string")
    probed = registry.cache_probe(requests, cache, "prompt_hash", "stored", F.lit(NOON))
    assert sorted((r["prompt_hash"], r["hit"]) for r in probed.collect()) == [
        ("a", True), ("a", True), ("b", False), ("c", False)]
    assert sorted(r[0] for r in registry.cache_misses(probed).collect()) == ["b", "c"]
    live = registry.unexpired(spark.createDataFrame([(5,), (9,)], "ttl bigint"), F.col("ttl"), F.lit(5))
    assert [r[0] for r in live.collect()] == [9]


def test_log_numbers(spark):
    df = spark.createDataFrame([(1 / 3,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(log_number(F.col("x"))).collect()]
    assert str(got[0]) == "0.3333333333" and got[1:] == [None, None]


def test_stored_charts(spark):
    log = spark.createDataFrame([
        ("s", NOON, "supervised", ["v/roc_curve_1", "v/confusion_1"]),
        ("s", NOON, "unsupervised", ["v/cluster_plot_1", "v/confusion_u"]),
        ("t", NOON, "unsupervised", ["v/confusion_t"]),
    ], "session_id string, timestamp timestamp, model_type string, visualizations array<string>")
    there = spark.createDataFrame([("v/confusion_1",), ("v/confusion_u",), ("v/cluster_plot_1",)], "path string")
    assert [tuple(r) for r in registry.stored_chart(log, there, "confusion").collect()] == [("s", "v/confusion_1")]
    assert registry.stored_chart(log, there, "roc").count() == 0
    assert registry.stored_chart(log, there, "cluster_plot").first()["path"] == "v/cluster_plot_1"


def test_pii(spark):
    df = spark.createDataFrame([
        ("write to a.b@example.com", 5551234567), ("call 555-123-4567 or 555.123.4568", 1), ("SSN 123-45-6789", 2),
        ("card 1234-5678 9012 3456", 3), (None, 4)], "t string, n bigint")
    found = {r["pii_type"]: (r["matches"], r["rows_with_match"]) for r in pii.pii_scan(df).collect()}
    assert found == {"email": (1, 1), "phone": (2, 1), "ssn": (1, 1), "credit_card": (1, 1)}
    numbers = {r["pii_type"]: r["matches"] for r in pii.pii_scan(df, ["n"]).collect()}
    assert numbers["phone"] == 1
    summary = pii.pii_summary(pii.pii_scan(df)).first()
    assert summary["pii_detected"] and summary["pii_details"]["phone"] == 2 and summary["warning_message"]
    clean = pii.pii_summary(pii.pii_scan(df.filter("t is null"))).first()
    assert not clean["pii_detected"] and clean["pii_details"] == {} and clean["warning_message"] is None
    assert pii.pii_scan(df, ["t"], sample_rows=1, key="n").agg(F.sum("matches")).first()[0] == 2


def test_responses(spark):
    texts = [
        '{"recommended_models": [{"model": "knn", "confidence": 1.5}, {"model": "svm"}], "reasoning": "r"}',
        'Sure: {"recommended_models": [{"model": "knn", "confidence": -2}]} done', "no json here",
        '{"recommended_models": [{"confidence": "high"}]}', '{"a": 1} junk}', "{}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = parse_responses(df, "t").orderBy("k").collect()
    assert [r["source"] for r in got] == ["structured", "structured", "raw", "raw", "raw", "structured"]
    assert [m["confidence"] for m in got[0]["recommended_models"]] == [1.0, 0.5]
    assert got[1]["recommended_models"][0]["confidence"] == 0.0
    assert got[2]["reasoning"] == "no json here" and got[5]["reasoning"] == ""
    assert got[5]["analysis_type"] == "exploratory"


def profiles(spark, **given):
    base = dict(dataset="d", num_rows=500, num_columns=3, numeric_columns=2, categorical_columns=1, size_class="medium",
                potential_targets=[("y", 2, "classification")], high_cardinality_columns=[], missing_percentage=0.0,
                has_missing_values=False, has_categorical=True, has_high_correlation=False)
    schema = ("dataset string, num_rows bigint, num_columns int, numeric_columns int, categorical_columns int, "
              "size_class string, potential_targets " + characteristics.TARGET_TYPE + ", high_cardinality_columns "
              "array<string>, missing_percentage double, has_missing_values boolean, has_categorical boolean, "
              "has_high_correlation boolean")
    row = {**base, **given}
    return spark.createDataFrame([tuple(row[part.split()[0]] for part in schema.replace(
        characteristics.TARGET_TYPE, "a").split(", "))], schema)


@pytest.mark.parametrize("given, analysis, names, steps", [
    ({}, "supervised_classification", ["logistic_regression", "knn", "random_forest"],
     ["one_hot_encoding", "standard_scaling"]),
    ({"num_rows": 5000, "has_missing_values": True, "missing_percentage": 4.0}, "supervised_classification",
     ["random_forest", "svm"], ["fill_null_mean", "one_hot_encoding", "standard_scaling"]),
    ({"potential_targets": [("y", 400, "regression")], "has_missing_values": True, "missing_percentage": 5.0,
      "high_cardinality_columns": ["c"]}, "supervised_regression", ["random_forest"],
     ["fill_null_median", "label_encoding", "standard_scaling"]),
    ({"potential_targets": [], "has_missing_values": True, "missing_percentage": 20.0, "has_categorical": False,
      "has_high_correlation": True}, "unsupervised_clustering", ["kmeans", "dbscan"],
     ["remove_null", "outlier_removal_iqr"]),
])
def test_model_rules(spark, given, analysis, names, steps):
    row = rules.recommend_models(profiles(spark, **given)).first()
    assert row["analysis_type"] == analysis
    assert [m["model"] for m in row["recommended_models"]] == names
    assert [s["step"] for s in row["recommended_preprocessing"]] == steps
    record = registry.decisions(rules.recommend_models(profiles(spark, **given)), F.lit("s"), F.lit(NOON)).first()
    assert record["primary_model"] == names[0] and record["session_id"] == "s"
    assert record["ttl"] - int((NOON - datetime(1970, 1, 1)).total_seconds()) == 30 * 24 * 3600


def test_display_and_request_key(spark):
    row = rules.display_strings(rules.recommend_models(profiles(spark))).first()
    assert row["model_suggestions"][0] == (
        "logistic_regression (confidence: 80%) - Good baseline for small classification datasets")
    assert row["feature_engineering_ideas"] == ["Rule-based analysis for medium dataset with 500 rows and 3 columns."]
    first, second = [rules.request_key(profiles(spark, num_rows=n)).first()["prompt_hash"] for n in (500, 501)]
    assert len(first) == 64 and first != second
    assert rules.request_key(profiles(spark)).first()["prompt_hash"] == first
    assert len(spark.range(1).select(text_hash(F.lit("x"))).first()[0]) == 64


def summary_row(spark, **given):
    base = dict(dataset="d", total_missing_percentage=0.0, duplicate_percentage=0.0, duplicate_rows=0,
                overall_imbalance_ratio=1.0, overall_quality_score=90.0, high_missing_columns=[],
                severely_imbalanced_columns=[], moderately_imbalanced_columns=[], columns_with_many_outliers=[],
                potential_conversions=[])
    types = ["string", "double", "double", "bigint", "double", "double"] + ["array<string>"] * 5
    row = {**base, **given}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {t}" for n, t in zip(row, types)))


def test_quality_rules(spark):
    assert rules.quality_recommendations(summary_row(spark)).first()["recommendations"] == [
        "Dataset quality is excellent for analysis"]
    bad = summary_row(
        spark, total_missing_percentage=25.0, duplicate_percentage=12.0, duplicate_rows=7, overall_imbalance_ratio=0.2,
        overall_quality_score=35.0, high_missing_columns=["a", "b", "c", "d"], severely_imbalanced_columns=["e"],
        columns_with_many_outliers=["f"], potential_conversions=["g"])
    texts = rules.quality_recommendations(bad).first()["recommendations"]
    assert texts[1] == "Consider removing columns with >50% missing values: a, b, c" and len(texts) == 7
    actions = rules.action_strings(rules.quality_actions(bad)).orderBy("position").collect()
    assert [(a["category"], a["priority"]) for a in actions] == [
        ("missing_values", "high"), ("duplicates", "medium"), ("class_imbalance", "high"), ("overall", "high")]
    assert actions[2]["text"].startswith("[high] consider_sampling - Class imbalance detected (ratio: 5.0)")
    assert rules.quality_actions(summary_row(spark)).count() == 0
    mild = summary_row(spark, total_missing_percentage=4.0, overall_quality_score=70.0)
    assert [(a["action"], a["priority"]) for a in rules.quality_actions(mild).collect()] == [
        ("fill_null", "low"), ("moderate_preprocessing", "medium")]


def test_summary_feeds_the_rules(ten):
    row = rules.quality_recommendations(quality.quality_summary(ten)).first()
    assert row["recommendations"] == ["Dataset quality is excellent for analysis"]
