"""Metadata tables, files and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.catalogue.base import CUSTOMER, LINEITEM, query, rounded, table
from veritab.catalogue.profiles import CHARACTERISTICS_SQL, DESCRIBED
from veritab.functions.numeric import from_log_number, log_number
from veritab.functions.text import parse_responses, text_hash
from veritab.operators.characteristics import dataset_characteristics
from veritab.operators.recommendations import recommend_models
from veritab.session import scratch_folder
from veritab.sources import datasets, readers, registry

# The events table stands in for an operation log: session = user, type = event type.


def _events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


@query("latest_operation", (
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY "
    "ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1"
))
def latest_operation(spark, folder):
    found = registry.latest_operation(_events(spark, folder), "ts", "user_id", ("event_type",), "event_id")
    return found.select("user_id", "event_type", "event_id")


@query("newest_operations", (
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) "
    "AS r FROM events) t WHERE r <= 10"
))
def newest_operations(spark, folder):
    return registry.newest_rows(_events(spark, folder), "user_id", "ts", 10, "event_id").select("user_id", "event_id")


@query("operation_status", (
    "SELECT session_id, operation_id, status, CASE WHEN status = 'completed' THEN props END AS results, CASE WHEN status "
    "= 'failed' THEN props END AS error FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS operation_id, "
    "CASE WHEN value > 100 THEN 'failed' WHEN value > 5 THEN 'completed' ELSE 'running' END AS status, props, "
    "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) t WHERE r = 1"
))
def operation_status(spark, folder):
    log = _events(spark, folder).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("operation_id"),
        F.col("event_id").alias("timestamp"),
        F.when(F.col("value") > 100, "failed").when(F.col("value") > 5, "completed").otherwise("running").alias("status"),
        F.col("props").alias("details"), F.col("props").alias("error"))
    return registry.operation_status(log)


@query("session_state", (
    "SELECT user_id AS session_id, max(event_id) AS updated_at, arg_max(event_type, event_id) FILTER (WHERE event_type "
    "= 'purchase') AS processed_path, arg_max(event_type, event_id) AS original_path, coalesce(arg_max(event_type, "
    "event_id) FILTER (WHERE event_type = 'purchase'), arg_max(event_type, event_id)) AS dataset_path FROM events "
    "GROUP BY user_id"
))
def session_state(spark, folder):
    records = _events(spark, folder).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("updated_at"),
        F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("processed_path"),
        F.col("event_type").alias("original_path"))
    return registry.current_sessions(records)


@query("cache_lookup", (
    "SELECT e.event_id, e.prompt_hash, c.stored IS NOT NULL AS hit, epoch_us(c.stored) AS stored_micros FROM (SELECT "
    "event_id, sha256(concat(user_id, event_type)) AS prompt_hash FROM events) e LEFT JOIN (SELECT "
    "sha256(concat(user_id, event_type)) AS prompt_hash, max(ts) AS stored FROM events WHERE ts >= (SELECT max(ts) FROM "
    "events) - INTERVAL 24 HOURS GROUP BY 1) c USING (prompt_hash)"
))
def cache_lookup(spark, folder):
    events = _events(spark, folder)
    key = text_hash(F.concat(F.col("user_id").cast("string"), "event_type")).alias("prompt_hash")
    now = events.agg(F.max("ts")).first()[0]
    probed = registry.cache_probe(
        events.select("event_id", key), events.select(key, F.col("ts").alias("stored")), "prompt_hash", "stored",
        F.lit(now).cast(events.schema["ts"].dataType))
    return probed.select(
        "event_id", "prompt_hash", "hit",
        F.unix_micros(F.col("cached.stored").cast("timestamp")).alias("stored_micros"))


@query("retention", (
    "SELECT event_id FROM events WHERE ts + INTERVAL 10 DAYS > (SELECT max(ts) FROM events)"
))
def retention(spark, folder):
    events = _events(spark, folder)
    now = events.agg(F.max("ts")).first()[0]
    return registry.unexpired(
        events, F.col("ts") + F.make_dt_interval(F.lit(10)), F.lit(now).cast(events.schema["ts"].dataType)
    ).select("event_id")


@query("retention_by_day", (
    "SELECT strftime(ts + INTERVAL 10 DAYS, '%Y-%m-%d') AS expiry_day, count(*) AS kept, max(event_id) AS newest "
    "FROM events WHERE CAST(ts + INTERVAL 10 DAYS AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1"
))
def retention_by_day(spark, folder):
    events = _events(spark, folder)
    path = scratch_folder(spark)
    ttl = F.unix_timestamp(F.col("ts").cast("timestamp")) + 10 * 86400
    registry.append_expiring(events.select("event_id", ttl.alias("ttl")), path)
    registry.drop_expired(spark, path, events.agg(F.max("ts")).first()[0])
    return spark.read.parquet(path).groupBy(F.col("expiry_day").cast("string").alias("expiry_day")).agg(
        F.count(F.lit(1)).alias("kept"), F.max("event_id").alias("newest"))


@query("log_values", (
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 3, 6) AS price, l_quantity * 1e30 AS large FROM lineitem"
))
def log_values(spark, folder):
    df = table(spark, folder, "lineitem")
    price = from_log_number(log_number(F.col("l_extendedprice") / 3))
    large = from_log_number(log_number(F.col("l_quantity") * F.lit(1e30)))
    return rounded(df.select("l_orderkey", "l_linenumber", price.alias("price"), large.alias("large")), ["price"])


@query("decisions", (
    "SELECT dataset AS session_id, 'model_recommendation' AS decision_type, CASE first_type WHEN 'classification' THEN "
    "CASE WHEN num_rows < 1000 THEN 'logistic_regression' ELSE 'random_forest' END WHEN 'regression' THEN "
    "'random_forest' ELSE 'kmeans' END AS primary_model, CASE first_type WHEN 'classification' THEN CASE WHEN num_rows "
    "< 1000 THEN 0.8 ELSE 0.85 END WHEN 'regression' THEN 0.8 ELSE 0.75 END::DOUBLE AS confidence_score, "
    f"CAST(1704067200 + 2592000 AS BIGINT) AS ttl FROM ({CHARACTERISTICS_SQL}) c"
))
def decisions(spark, folder):
    recommended = recommend_models(reduce(DataFrame.unionAll, [
        dataset_characteristics(s.frame(spark, folder), s.name) for s in DESCRIBED]))
    found = registry.decisions(recommended, F.col("dataset"), F.timestamp_seconds(F.lit(1704067200)))
    return found.select("session_id", "decision_type", "primary_model",
                        F.col("confidence_score").cast("double").alias("confidence_score"), "ttl")


@query("stored_chart", (
    "WITH log AS (SELECT user_id AS session_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'supervised' "
    "ELSE 'unsupervised' END AS model_type, concat('charts/', event_type, '_', event_id) AS path, value FROM events), "
    "newest AS (SELECT *, row_number() OVER (PARTITION BY session_id, model_type ORDER BY event_id DESC) AS r FROM log) "
    "SELECT session_id, arg_min(path, CASE model_type WHEN 'supervised' THEN 0 ELSE 1 END) AS path FROM newest "
    "WHERE r = 1 AND contains(path, 'c') AND value > 1 GROUP BY session_id"
))
def stored_chart(spark, folder):
    path = F.concat(F.lit("charts/"), "event_type", F.lit("_"), F.col("event_id").cast("string"))
    events = _events(spark, folder)
    log = events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("timestamp"),
        F.when(F.col("event_type").isin("click", "view"), "supervised").otherwise("unsupervised").alias("model_type"),
        F.array(path).alias("visualizations"))
    return registry.stored_chart(log, events.filter(F.col("value") > 1).select(path.alias("path")), "c")


# --- files ------------------------------------------------------------------


@query("csv_roundtrip", (
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM "
    f"{CUSTOMER.sql} t"
))
def csv_roundtrip(spark, folder):
    root = scratch_folder(spark)
    path = datasets.export_csv(CUSTOMER.frame(spark, folder), f"{root}/customer.csv")
    datasets.write_version(readers.read_csv(spark, path), root, "session")
    return rounded(datasets.load_version(spark, root, "session"), ["c_acctbal"])


# --- texts ------------------------------------------------------------------


@query("prompt_hash", "SELECT conv_id, turn, sha256(text) AS prompt_hash FROM conversations")
def prompt_hash(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text_hash(F.col("text")).alias("prompt_hash"))


@query("parse_responses", (
    "SELECT event_id, CASE WHEN value < 3 THEN 'raw' ELSE 'structured' END AS source, CASE WHEN value < 3 THEN "
    "'exploratory' ELSE event_type END AS analysis_type, CASE WHEN value < 3 THEN concat('no answer for ', event_type) "
    "ELSE 'because' END AS reasoning, CASE WHEN value < 3 THEN NULL ELSE event_type END AS model, CASE WHEN value < 3 "
    "THEN NULL ELSE round(least(1.0, value / 50), 6) END AS confidence, CASE WHEN value < 3 THEN NULL ELSE 0.5::DOUBLE END AS "
    "default_confidence FROM events"
))
def parse_responses_query(spark, folder):
    answer = F.format_string(
        'Here: {"recommended_models": [{"model": "%s", "confidence": %s}, {"model": "other"}], '
        '"analysis_type": "%s", "reasoning": "because"} as asked',
        "event_type", (F.col("value") / 50).cast("string"), "event_type")
    texts = _events(spark, folder).select(
        "event_id",
        F.when(F.col("value") < 3, F.concat(F.lit("no answer for "), "event_type")).otherwise(answer).alias("text"))
    models = F.col("recommended_models")
    return rounded(parse_responses(texts, "text").select(
        "event_id", "source", "analysis_type", "reasoning", F.get(models, F.lit(0))["model"].alias("model"),
        F.get(models, F.lit(0))["confidence"].alias("confidence"),
        F.get(models, F.lit(1))["confidence"].alias("default_confidence"),
    ), ["confidence"])
