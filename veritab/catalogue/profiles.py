"""Profiles, quality reports, correlation and personal-data scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.catalogue.base import (
    CUSTOMER, EVENTS, LABELS, LINEITEM, ORDERS, PART, SUPPLIER, Source, as_bigint, listed, percent_sql, query,
    rounded, table, union_sql,
)
from veritab.operators import charts, correlation, pii, profile, quality, values
from veritab.operators import characteristics as traits
from veritab.operators import recommendations as rules

NUMERIC = LINEITEM.of("integer", "float")
STATISTICS = ["mean", "median", "std", "min", "max", "q25", "q75"]


# --- column profiles --------------------------------------------------------


def _numeric_sql(src: Source, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS \"column\", '{src.types[c]}' AS data_type, count(*) AS total_count, "
        f"count(*) - count({c}) AS missing_count, {percent_sql(f'(count(*) - count({c}))', 'count(*)')} AS "
        f"missing_percentage, count(DISTINCT {c}) AS distinct_count, round(avg({x}), 7) AS mean, "
        f"round(median({x}), 6) AS median, round(coalesce(stddev_samp({x}), 0), 6) AS std, round(min({x}), 6) AS min, "
        f"round(max({x}), 6) AS max, round(quantile_cont({x}, 0.25), 6) AS q25, "
        f"round(quantile_cont({x}, 0.75), 6) AS q75 FROM {src.sql} t"
    )


@query("profile_numeric", union_sql([_numeric_sql(LINEITEM, c) for c in NUMERIC]))
def profile_numeric(spark, folder):
    found = profile.column_statistics(LINEITEM.frame(spark, folder), NUMERIC)
    # Means of two-decimal prices can lie exactly between two values of 6 places, hence 7.
    return rounded(rounded(found.select(
        "column", "data_type", "total_count", "missing_count", "missing_percentage", "distinct_count", *STATISTICS
    ), ["mean"], 7), STATISTICS[1:])


def _missing_sql(src: Source) -> str:
    inner = union_sql([
        f"SELECT '{c}' AS \"column\", count(*) AS total_count, count(*) - count({c}) AS missing_count, "
        f"{percent_sql(f'(count(*) - count({c}))', 'count(*)')} AS missing_percentage FROM {src.sql} t"
        for c in src.columns
    ])
    return (
        'SELECT "column", total_count, missing_count, missing_percentage, CASE WHEN missing_count = 0 THEN '
        "'complete' WHEN missing_percentage > 50 THEN 'high' WHEN missing_percentage > 10 THEN 'moderate' "
        f"ELSE 'low' END AS band FROM ({inner}) m"
    )


@query("profile_missing", _missing_sql(ORDERS))
def profile_missing(spark, folder):
    return quality.missing_by_column(ORDERS.frame(spark, folder)).drop("position")


@query("missing_summary", (
    "SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing, count(*) FILTER (WHERE missing_count > 0) AS "
    f"columns_with_missing, {percent_sql('sum(missing_count)', 'sum(total_count)')} AS missing_percentage "
    f"FROM ({_missing_sql(ORDERS)}) s"
))
def missing_summary(spark, folder):
    return profile.dataset_missing_summary(profile.column_statistics(ORDERS.frame(spark, folder)))


@query("profile_boolean", union_sql([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 1) AS true_count, count(*) FILTER (WHERE {c} <> 1) AS "
    f"false_count, {percent_sql(f'count(*) FILTER (WHERE {c} = 1)', 'count(*)')} AS true_percentage FROM labels"
    for c in ("quality", "toxic")
]))
def profile_boolean(spark, folder):
    flags = LABELS.frame(spark, folder).select((F.col("quality") == 1).alias("quality"),
                                               (F.col("toxic") == 1).alias("toxic"))
    return profile.column_statistics(flags).select("column", "true_count", "false_count", "true_percentage")


@query("basic_metrics", (
    "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, count(*) * 11 AS total_cells, "
    f"'{','.join(LINEITEM.columns)}' AS column_names FROM lineitem"
))
def basic_metrics(spark, folder):
    found = profile.basic_metrics(LINEITEM.frame(spark, folder))
    return as_bigint(found, ["total_columns"]).withColumn("column_names", listed("column_names"))


# --- values -----------------------------------------------------------------

TOP = [(EVENTS, "event_type"), (ORDERS, "o_orderpriority"), (PART, "p_brand")]


@query("value_counts_top10", union_sql([
    f"SELECT \"column\", value, n, rank FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, "
    f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {s.sql} t WHERE {c} IS NOT NULL GROUP BY {c}) v "
    "WHERE rank <= 10" for s, c in TOP
]))
def value_counts_top10(spark, folder):
    parts = [values.top_values(s.frame(spark, folder), [c]) for s, c in TOP]
    return as_bigint(reduce(DataFrame.unionAll, parts), ["rank"])


@query("distinct_counts", union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {LINEITEM.sql} t"
    for c in LINEITEM.columns
]))
def distinct_counts(spark, folder):
    return values.distinct_counts(LINEITEM.frame(spark, folder))


@query("sample_values", (
    f"SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value FROM {ORDERS.sql} t "
    "WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 5"
))
def sample_values(spark, folder):
    return values.sample_values(ORDERS.frame(spark, folder), "o_orderpriority", "o_orderkey")


@query("preview_rows", (
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority "
    f"FROM {ORDERS.sql} t ORDER BY o_orderkey LIMIT 10"
))
def preview_rows(spark, folder):
    first = profile.preview(ORDERS.frame(spark, folder), "o_orderkey").drop("o_orderdate")
    return rounded(first, ["o_totalprice"])


@query("preview_size", (
    "SELECT least(count(*), 10) AS rows_shown, count(*) AS total_rows_available FROM orders"
))
def preview_size(spark, folder):
    return as_bigint(profile.preview_size(table(spark, folder, "orders")), ["rows_shown"])


# --- types ------------------------------------------------------------------

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _types_sql(src: Source, text: bool = False) -> str:
    parts = []
    for i, c in enumerate(src.columns):
        if text or src.types[c] == "categorical":
            value = f"CAST({c} AS VARCHAR)"
            inferred = (
                f"CASE WHEN count({c}) > 0 AND count(*) FILTER (WHERE regexp_matches({value}, '{NUMBER}')) = count({c}) "
                f"THEN 'numeric_string' WHEN count({c}) > 0 AND count(TRY_CAST({value} AS TIMESTAMP)) = count({c}) "
                "THEN 'datetime_string' ELSE 'categorical' END")
        else:
            inferred = f"max('{src.types[c]}')"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {inferred} AS inferred_type FROM {src.sql} t")
    return union_sql(parts)


def _as_text(src: Source, spark, folder) -> DataFrame:
    df = src.frame(spark, folder)
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


TYPED = [CUSTOMER, EVENTS]


# Dates as texts, with the format all values of a column share; the third mixes two.
DATED = {
    "us": ("MM/dd/yyyy", "%m/%d/%Y"), "dotted": ("d.M.yyyy H:mm", "%-d.%-m.%Y %-H:%M"), "named": ("MMM d, yyyy", "%b %-d, %Y"),
    "short": ("dd-MM-yy", "%d-%m-%y"),
}


def _dated(spark, folder) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    return ORDERS.frame(spark, folder).select(
        *[F.date_format(day, spark_format).alias(c) for c, (spark_format, _) in DATED.items()],
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(
            F.date_format(day, "dd/MM/yyyy")).alias("mixed"))


def _dated_sql() -> str:
    texts = ", ".join(f"strftime(o_orderdate, '{fmt}') AS {c}" for c, (_, fmt) in DATED.items())
    mixed = "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END"
    fits = {c: f"try_strptime({c}, '{fmt}')" for c, (_, fmt) in DATED.items()}
    fits["mixed"] = ""
    both = " AND ".join(f"count(try_strptime(mixed, '{f}')) < count(mixed)" for f in ("%m/%d/%Y", "%d/%m/%Y"))
    return union_sql([
        f"SELECT '{c}' AS \"column\", CASE WHEN " + (f"NOT ({both})" if c == "mixed" else f"count({fit}) = count({c})")
        + f" THEN 'datetime_string' ELSE 'categorical' END AS inferred_type FROM (SELECT {texts}, {mixed} AS mixed "
        f"FROM {ORDERS.sql} s) t" for c, fit in fits.items()])


@query("type_inference", 'SELECT "column", inferred_type FROM (' + union_sql([
    _types_sql(s, text=True) for s in TYPED]) + ") t UNION ALL " + _dated_sql())
def type_inference(spark, folder):
    parts = [profile.infer_types(_as_text(s, spark, folder)) for s in TYPED]
    return reduce(DataFrame.unionAll, [*parts, profile.infer_types(_dated(spark, folder))]).select(
        "column", "inferred_type")


@query("type_report", union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, (SELECT string_agg(v, ',' ORDER BY {order}) FROM "
    f"(SELECT DISTINCT CAST({c} AS {kind}) AS v, {c} AS x FROM {ORDERS.sql} s WHERE {c} IS NOT NULL ORDER BY {order} "
    f"LIMIT 5) d) AS sample_values FROM {ORDERS.sql} t"
    for c, order, kind in [("o_orderstatus", "v", "VARCHAR"), ("o_orderpriority", "v", "VARCHAR"),
                           ("o_custkey", "x", "VARCHAR")]
]) + (
    " UNION ALL SELECT 'us', count(DISTINCT us), (SELECT string_agg(us, ',' ORDER BY us) FROM (SELECT DISTINCT "
    "strftime(o_orderdate, '%m/%d/%Y') AS us FROM orders ORDER BY us LIMIT 5) d) FROM (SELECT "
    "strftime(o_orderdate, '%m/%d/%Y') AS us FROM orders) t"))
def type_report(spark, folder):
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    found = profile.type_report(ORDERS.frame(spark, folder), columns).unionAll(
        profile.type_report(_dated(spark, folder), ["us"]))
    return found.select("column", "distinct_count", listed("sample_values").alias("sample_values"))


@query("type_histogram", (
    f"SELECT inferred_type AS data_type, count(*) AS columns FROM ({_types_sql(EVENTS)}) t GROUP BY inferred_type"
))
def type_histogram(spark, folder):
    types = profile.infer_types(EVENTS.frame(spark, folder))
    return profile.type_histogram(types.withColumnRenamed("inferred_type", "data_type"))


# --- duplicates -------------------------------------------------------------

COPIED = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
COPIED_SQL = f"(SELECT {', '.join(COPIED)} FROM {LINEITEM.sql} s)"


@query("duplicates", (
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
    f"{percent_sql('sum(n - 1)', 'sum(n)')} AS duplicate_percentage, count(*) AS unique_rows, "
    "count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n - 1) > 0 AS has_duplicates "
    f"FROM (SELECT count(*) AS n FROM {COPIED_SQL} t GROUP BY {', '.join(COPIED)}) g"
))
def duplicates(spark, folder):
    return quality.duplicate_summary(LINEITEM.frame(spark, folder), COPIED)


@query("duplicate_keys", (
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS "
    "copy FROM events) t WHERE copy > 1 ORDER BY event_id LIMIT 100"
))
def duplicate_keys(spark, folder):
    return quality.duplicate_keys(EVENTS.frame(spark, folder), "event_id", ["user_id", "event_type"])


# --- imbalance and outliers -------------------------------------------------


def _imbalance_sql(src: Source, columns: list[str]) -> str:
    return union_sql([
        f"SELECT '{c}' AS \"column\", count(*) AS unique_values, min(n) / CAST(max(n) AS DOUBLE) AS ratio_unrounded, "
        "round_even(min(n) / CAST(max(n) AS DOUBLE), 3) AS imbalance_ratio, "
        "-sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE) + 1e-10)) AS entropy, "
        "max(n) AS most_frequent_count, min(n) AS least_frequent_count, "
        "arg_min(value, rank) AS most_frequent_value, arg_max(value, rank) AS least_frequent_value, "
        "string_agg(value || ':' || n, ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS value_distribution "
        f"FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, "
        f"row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM {src.sql} t "
        f"WHERE {c} IS NOT NULL GROUP BY {c}) v HAVING count(*) > 1"
        for c in columns
    ])


IMBALANCED = [(EVENTS, ["event_type", "props"]), (ORDERS, ["o_orderstatus", "o_orderpriority"]), (CUSTOMER, ["c_mktsegment"])]


@query("imbalance", (
    'SELECT "column", unique_values, imbalance_ratio, round(entropy, 6) AS entropy, '
    "round(entropy / log2(unique_values), 6) AS normalized_entropy, most_frequent_value, most_frequent_count, "
    "least_frequent_value, least_frequent_count, CASE WHEN imbalance_ratio < 0.1 THEN 'severe' "
    "WHEN imbalance_ratio < 0.3 THEN 'moderate' ELSE 'balanced' END AS band, value_distribution FROM ("
    + union_sql([_imbalance_sql(s, cs) for s, cs in IMBALANCED]) + ") i"
))
def imbalance(spark, folder):
    parts = [quality.imbalance_by_column(s.frame(spark, folder), cs) for s, cs in IMBALANCED]
    shown = listed(F.transform("value_distribution", lambda v: F.concat(v["value"], F.lit(":"), v["n"].cast("string"))))
    return rounded(reduce(DataFrame.unionAll, parts).drop("ratio_unrounded"), [
        "entropy", "normalized_entropy"]).withColumn("value_distribution", shown)


def _outlier_sql(src: Source, columns: list[str]) -> str:
    return union_sql([
        f"SELECT '{c}' AS \"column\", count(x) AS value_count, "
        "count(*) FILTER (WHERE x < low OR x > high) AS iqr_outliers, "
        f"{percent_sql('count(*) FILTER (WHERE x < low OR x > high)', 'count(x)')} AS iqr_outlier_percentage, "
        "count(*) FILTER (WHERE std > 0 AND abs((x - mean) / std) > 3) AS zscore_outliers, "
        f"{percent_sql('count(*) FILTER (WHERE std > 0 AND abs((x - mean) / std) > 3)', 'count(x)')} AS "
        "zscore_outlier_percentage, round(any_value(low), 6) AS lower_bound, round(any_value(high), 6) AS upper_bound, "
        "round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(min(x), 6) AS min, "
        "round(max(x), 6) AS max FROM "
        f"(SELECT CAST({c} AS DOUBLE) AS x FROM {src.sql} s) v, "
        f"(SELECT quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS low, "
        "quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS high, avg(x) AS mean, "
        f"stddev_samp(x) AS std FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src.sql} s) w) b"
        for c in columns
    ])


OUTLYING = [(EVENTS, ["value"]), (LINEITEM, ["l_extendedprice", "l_quantity", "l_tax"])]


@query("outlier_report", union_sql([_outlier_sql(s, cs) for s, cs in OUTLYING]))
def outlier_report(spark, folder):
    parts = [quality.outlier_counts(s.frame(spark, folder), cs) for s, cs in OUTLYING]
    return rounded(reduce(DataFrame.unionAll, parts).drop("position"),
                   ["lower_bound", "upper_bound", "mean", "std", "min", "max"])


# --- quality score ----------------------------------------------------------


def quality_sql(src: Source, dataset: str) -> str:
    """One row per dataset: the measures, the name lists and the score."""
    keys = ", ".join(src.columns)
    texts = src.of("categorical", "datetime")
    empty = "SELECT NULL::VARCHAR AS \"column\", 1.0::DOUBLE AS ratio_unrounded, 1.0::DOUBLE AS imbalance_ratio WHERE false"
    ratios = (
        f"SELECT \"column\", ratio_unrounded, imbalance_ratio FROM ({_imbalance_sql(src, texts)}) r" if texts else empty)
    spread = _outlier_sql(src, src.of("integer", "float"))
    return (
        "SELECT *, greatest(0, 100 - total_missing_percentage * 2) * 0.25 + greatest(0, 100 - duplicate_percentage * 3) "
        "* 0.20 + overall_imbalance_ratio * 100 * 0.20 + coalesce(greatest(0, 100 - average_outlier_percentage * 2), "
        f"100) * 0.15 + (1 - conversion_count / {float(len(src.columns))}) * 100 * 0.20 AS score_unrounded FROM (SELECT "
        f"'{dataset}' AS dataset, "
        f"(SELECT max(total_count) FROM ({_missing_sql(src)}) m) AS total_rows, "
        f"(SELECT CAST(sum(missing_count) AS BIGINT) FROM ({_missing_sql(src)}) m) AS total_missing, "
        f"(SELECT {percent_sql('sum(missing_count)', 'sum(total_count)')} FROM ({_missing_sql(src)}) m) AS "
        "total_missing_percentage, "
        f"(SELECT coalesce(string_agg(\"column\", ',' ORDER BY \"column\"), '') FROM ({_missing_sql(src)}) m "
        "WHERE band = 'high') AS high_missing_columns, "
        f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {src.sql} t GROUP BY {keys}) d) AS "
        "duplicate_rows, "
        f"(SELECT {percent_sql('sum(n - 1)', 'sum(n)')} FROM (SELECT count(*) AS n FROM {src.sql} t GROUP BY {keys}) d) "
        "AS duplicate_percentage, "
        f"(SELECT round_even(coalesce(avg(ratio_unrounded), 1.0), 3) FROM ({ratios}) r) AS overall_imbalance_ratio, "
        f"(SELECT count(*) FROM ({ratios}) r WHERE imbalance_ratio < 0.1) AS severe_count, "
        f"(SELECT count(*) FROM ({ratios}) r WHERE imbalance_ratio >= 0.1 AND imbalance_ratio < 0.3) AS moderate_count, "
        f"(SELECT avg(iqr_outlier_percentage) FROM ({spread}) o) AS average_outlier_percentage, "
        f"(SELECT coalesce(string_agg(\"column\", ', ' ORDER BY \"column\"), '') FROM ({spread}) o "
        "WHERE iqr_outlier_percentage > 10) AS outlier_columns, "
        f"(SELECT count(*) FROM ({_types_sql(src)}) y WHERE inferred_type IN ('numeric_string', 'datetime_string')) AS "
        "conversion_count) q"
    )


def _summary(src: Source, spark, folder) -> DataFrame:
    return quality.quality_summary(src.frame(spark, folder)).withColumn("dataset", F.lit(src.name))


@query("quality_score", (
    "SELECT dataset, total_rows, total_missing, total_missing_percentage, high_missing_columns, duplicate_rows, "
    "duplicate_percentage, overall_imbalance_ratio, round(average_outlier_percentage, 6) AS "
    "average_outlier_percentage, conversion_count, round(score_unrounded, 6) AS score_unrounded "
    f"FROM ({quality_sql(LINEITEM, 'lineitem')}) s"
))
def quality_score(spark, folder):
    found = _summary(LINEITEM, spark, folder)
    return rounded(found.select(
        "dataset", "total_rows", "total_missing", "total_missing_percentage",
        listed("high_missing_columns").alias("high_missing_columns"), "duplicate_rows", "duplicate_percentage",
        "overall_imbalance_ratio", "average_outlier_percentage",
        F.size("potential_conversions").cast("bigint").alias("conversion_count"), "score_unrounded",
    ), ["average_outlier_percentage", "score_unrounded"])


RATED = [ORDERS, CUSTOMER, PART, SUPPLIER, LABELS]
RATED_SQL = union_sql([quality_sql(s, s.name) for s in RATED])


def _summaries(spark, folder) -> DataFrame:
    return reduce(DataFrame.unionByName, [_summary(s, spark, folder) for s in RATED])


def _case(*branches: str) -> str:
    return f"CASE {' '.join(branches)} END"


@query("quality_recommendations", (
    "SELECT dataset, overall_quality_score, concat_ws(' | ', "
    + _case("WHEN total_missing_percentage > 20 THEN 'High percentage of missing values detected - consider data "
            "collection improvements'",
            "WHEN total_missing_percentage > 10 THEN 'Moderate missing values - implement imputation strategies'") + ", "
    + _case("WHEN high_missing_columns <> '' THEN concat('Consider removing columns with >50% missing values: ', "
            "replace(high_missing_columns, ',', ', '))") + ", "
    + _case("WHEN duplicate_percentage > 10 THEN 'High number of duplicate rows - remove duplicates to improve data "
            "quality'",
            "WHEN duplicate_percentage > 1 THEN 'Some duplicate rows detected - consider deduplication'") + ", "
    + _case("WHEN severe_count > 0 THEN 'Severe class imbalance detected - consider resampling techniques'",
            "WHEN moderate_count > 0 THEN 'Moderate class imbalance - monitor model performance carefully'") + ", "
    + _case("WHEN outlier_columns <> '' THEN concat('Many outliers detected in: ', outlier_columns)") + ", "
    + _case("WHEN conversion_count > 0 THEN 'Some columns may benefit from type conversion for better analysis'") + ", "
    + _case("WHEN overall_quality_score >= 80 THEN 'Dataset quality is excellent for analysis'",
            "WHEN overall_quality_score >= 60 THEN 'Dataset quality is good with minor improvements needed'",
            "WHEN overall_quality_score >= 40 THEN 'Dataset quality is moderate - several improvements recommended'",
            "ELSE 'Dataset quality is poor - significant preprocessing required'")
    + f") AS recommendations FROM (SELECT *, round_even(score_unrounded, 1) AS overall_quality_score FROM ({RATED_SQL}) a) s"
))
def quality_recommendations(spark, folder):
    found = rules.quality_recommendations(_summaries(spark, folder))
    return found.select("dataset", "overall_quality_score", F.array_join("recommendations", " | ").alias("recommendations"))


@query("quality_actions", (
    "SELECT dataset, category, action, priority FROM (SELECT *, round_even(score_unrounded, 1) AS score, "
    "1.0 / nullif(overall_imbalance_ratio, 0) AS ratio "
    f"FROM ({RATED_SQL}) a) s, LATERAL (SELECT * FROM (VALUES "
    "(CASE WHEN total_missing_percentage > 0 THEN 'missing_values' END, "
    "CASE WHEN total_missing_percentage < 5 THEN 'fill_null' WHEN total_missing_percentage < 20 THEN "
    "'fill_null_median' ELSE 'review_columns' END, "
    "CASE WHEN total_missing_percentage < 5 THEN 'low' WHEN total_missing_percentage < 20 THEN 'medium' ELSE 'high' END), "
    "(CASE WHEN duplicate_rows > 0 THEN 'duplicates' END, 'remove_duplicates', 'medium'), "
    "(CASE WHEN ratio > 3.0 THEN 'class_imbalance' END, 'consider_sampling', 'high'), "
    "(CASE WHEN score < 75 THEN 'overall' END, CASE WHEN score < 50 THEN 'extensive_preprocessing' ELSE "
    "'moderate_preprocessing' END, CASE WHEN score < 50 THEN 'high' ELSE 'medium' END)"
    ") v(category, action, priority) WHERE category IS NOT NULL) l"
))
def quality_actions(spark, folder):
    return rules.quality_actions(_summaries(spark, folder)).select("dataset", "category", "action", "priority")


# --- correlation ------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


def _corr_sql(a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, nullif(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), "
        f"'NaN'::DOUBLE) AS correlation FROM (SELECT *, 1 AS fixed FROM {LINEITEM.sql} s) t")


@query("correlation_matrix", "SELECT column_1, column_2, round(correlation, 6) AS correlation FROM (" + union_sql([
    _corr_sql(a, b) for a in [*NUMERIC, "fixed"] for b in [*NUMERIC, "fixed"]]) + ") c")
def correlation_matrix(spark, folder):
    df = LINEITEM.frame(spark, folder).withColumn("fixed", F.lit(1))
    found = correlation.correlation_matrix(df, [*NUMERIC, "fixed"])
    return rounded(found.select("column_1", "column_2", "correlation"), ["correlation"])


@query("correlated_pairs", (
    "SELECT column_1, column_2, round(correlation, 6) AS correlation, CASE WHEN abs(correlation) >= 0.9 THEN 'strong' "
    "ELSE 'moderate' END AS strength FROM (SELECT 'l_extendedprice' AS column_1, 'gross' AS column_2, "
    "corr(l_extendedprice, l_extendedprice * (1 + l_tax)) AS correlation FROM " + LINEITEM.sql + " t UNION ALL "
    "SELECT 'l_extendedprice', 'net', corr(l_extendedprice, l_extendedprice * (1 - 5 * l_discount)) FROM "
    + LINEITEM.sql + " t UNION ALL SELECT 'gross', 'net', corr(l_extendedprice * (1 + l_tax), l_extendedprice * "
    "(1 - 5 * l_discount)) FROM " + LINEITEM.sql + " t) p WHERE abs(correlation) >= 0.8"
))
def correlated_pairs(spark, folder):
    df = LINEITEM.frame(spark, folder).select(
        "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"),
        (F.col("l_extendedprice") * (1 - 5 * F.col("l_discount"))).alias("net"))
    return rounded(correlation.highly_correlated(correlation.correlation_pairs(df)), ["correlation"])


@query("heatmap_cells", (
    "SELECT column_2 AS \"row\", column_1 AS \"column\", round(correlation, 6) AS correlation FROM ("
    + union_sql([_corr_sql(a, b) for a, b in PAIRS]) + ") c"
))
def heatmap_cells(spark, folder):
    return rounded(correlation.heatmap_cells(LINEITEM.frame(spark, folder)), ["correlation"])


@query("high_correlation_flag", (
    "SELECT coalesce(max(abs(correlation)) > 0.8, false) AS has_high_correlation FROM ("
    + union_sql([_corr_sql(a, b) for a, b in PAIRS]) + ") c"
))
def high_correlation_flag(spark, folder):
    return correlation.has_high_correlation(correlation.correlation_pairs(LINEITEM.frame(spark, folder)))


# --- personal data ----------------------------------------------------------


def _pii_sql(relation: str, c: str) -> str:
    return union_sql([
        f"SELECT '{c}' AS \"column\", '{kind}' AS pii_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, "
        f"count(*) FILTER (WHERE n > 0) AS rows_with_match FROM (SELECT len(regexp_extract_all({c}, '{pattern}')) AS n "
        f"FROM {relation} r) t"
        for kind, pattern in pii.PII_PATTERNS.items()
    ])


SCANNED = [("documents", "text"), ("pages", "html"), ("conversations", "text")]


@query("pii_scan", union_sql([
    f"SELECT '{t}' AS dataset, * FROM ({_pii_sql(t, c)}) p" for t, c in SCANNED]))
def pii_scan(spark, folder):
    return reduce(DataFrame.unionAll, [
        pii.pii_scan(table(spark, folder, t), [c]).select(F.lit(t).alias("dataset"), "*") for t, c in SCANNED
    ])


@query("pii_summary", (
    "SELECT sum(matches) > 0 AS pii_detected, coalesce(string_agg(CASE WHEN matches > 0 THEN concat(pii_type, ':', "
    "matches) END, ',' ORDER BY pii_type), '') AS pii_details, CASE WHEN sum(matches) > 0 THEN "
    f"'{pii.PII_WARNING}' END AS warning_message FROM ({_pii_sql('documents', 'text')}) p"
))
def pii_summary(spark, folder):
    found = pii.pii_summary(pii.pii_scan(table(spark, folder, "documents"), ["text"]))
    return found.withColumn("pii_details", F.array_join(F.transform(
        F.map_entries("pii_details"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query("pii_preview", _pii_sql("(SELECT text FROM documents ORDER BY doc_id LIMIT 10)", "text"))
def pii_preview(spark, folder):
    """The ten-row form of the scan, which is a feature of the upload report."""
    return pii.pii_scan(table(spark, folder, "documents"), ["text"], sample_rows=10, key="doc_id")


# --- characteristics and model rules ------------------------------------------

DESCRIBED = [ORDERS, CUSTOMER, PART, LABELS, SUPPLIER]


def _overview_sql(src: Source) -> str:
    return union_sql([
        f"SELECT {i} AS position, '{c}' AS \"column\", '{src.types[c]}' AS data_type, count(*) AS total_count, "
        f"count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS distinct_count FROM {src.sql} t"
        for i, c in enumerate(src.columns)
    ])


def _targets_sql(src: Source) -> str:
    return (
        "SELECT CASE WHEN type = 'classification' THEN 0 ELSE 1 END AS kind_rank, position, \"column\", "
        "distinct_count AS unique_values, type FROM (SELECT *, CASE WHEN distinct_count BETWEEN 2 AND 20 AND "
        "distinct_count < total_count * 0.1 THEN 'classification' WHEN data_type IN ('integer', 'float') AND "
        "distinct_count > 20 AND distinct_count > total_count * 0.5 THEN 'regression' END AS type "
        f"FROM ({_overview_sql(src)}) o) k WHERE type IS NOT NULL"
    )


@query("target_candidates", union_sql([
    f"SELECT '{s.name}' AS dataset, \"column\", unique_values, type FROM ({_targets_sql(s)}) t" for s in DESCRIBED]))
def target_candidates(spark, folder):
    return reduce(DataFrame.unionAll, [
        traits.target_candidates(traits.column_overview(s.frame(spark, folder)))
        .select(F.lit(s.name).alias("dataset"), "column", "unique_values", "type") for s in DESCRIBED
    ])


def _characteristics_sql(src: Source) -> str:
    numeric = src.of("integer", "float")
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    high = union_sql([
        f"SELECT nullif(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 'NaN'::DOUBLE) AS r FROM {src.sql} t"
        for a, b in pairs])
    overview = _overview_sql(src)
    return (
        f"SELECT '{src.name}' AS dataset, max(total_count) AS num_rows, count(*) AS num_columns, "
        "count(*) FILTER (WHERE data_type IN ('integer', 'float')) AS numeric_columns, "
        "count(*) FILTER (WHERE data_type = 'categorical') AS categorical_columns, "
        "count(*) FILTER (WHERE data_type = 'datetime') AS datetime_columns, "
        "CAST(sum(missing_count) AS BIGINT) AS missing_values, "
        f"{percent_sql('sum(missing_count)', 'sum(total_count)')} AS missing_percentage, "
        "coalesce(string_agg(CASE WHEN data_type = 'categorical' AND distinct_count > 50 THEN \"column\" END, ',' "
        "ORDER BY position), '') AS high_cardinality_columns, "
        f"(SELECT coalesce(string_agg(\"column\", ',' ORDER BY kind_rank, position), '') FROM ({_targets_sql(src)}) t) "
        "AS potential_targets, "
        f"(SELECT coalesce(arg_min(type, kind_rank * 1000 + position), 'none') FROM ({_targets_sql(src)}) t) AS "
        "first_type, "
        f"(SELECT coalesce(max(abs(r)) > 0.8, false) FROM ({high}) h) AS has_high_correlation, "
        "CASE WHEN max(total_count) < 100 THEN 'small' WHEN max(total_count) < 10000 THEN 'medium' ELSE 'large' END AS "
        f"size_class FROM ({overview}) o"
    )


def _characteristics(spark, folder) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        traits.dataset_characteristics(s.frame(spark, folder), s.name) for s in DESCRIBED])


CHARACTERISTICS_SQL = union_sql([_characteristics_sql(s) for s in DESCRIBED])
COUNTS = ["num_columns", "numeric_columns", "categorical_columns", "datetime_columns"]


@query("dataset_characteristics", (
    "SELECT dataset, num_rows, num_columns, numeric_columns, categorical_columns, datetime_columns, missing_values, "
    "missing_percentage, high_cardinality_columns, potential_targets, has_high_correlation, size_class "
    f"FROM ({CHARACTERISTICS_SQL}) c"
))
def dataset_characteristics(spark, folder):
    found = _characteristics(spark, folder)
    return as_bigint(found.select(
        "dataset", "num_rows", *COUNTS, "missing_values", "missing_percentage",
        listed("high_cardinality_columns").alias("high_cardinality_columns"),
        listed(F.transform("potential_targets", lambda t: t["column"])).alias("potential_targets"),
        "has_high_correlation", "size_class",
    ), COUNTS)


@query("recommend_models", (
    "SELECT dataset, CASE first_type WHEN 'classification' THEN 'supervised_classification' WHEN 'regression' THEN "
    "'supervised_regression' ELSE 'unsupervised_clustering' END AS analysis_type, "
    "CASE WHEN first_type = 'classification' AND num_rows < 1000 THEN "
    "'logistic_regression:0.8,knn:0.65,random_forest:0.75' WHEN first_type = 'classification' THEN "
    "'random_forest:0.85,svm:0.7' WHEN first_type = 'regression' THEN 'random_forest:0.8' ELSE "
    "'kmeans:0.75,dbscan:0.6' END AS models, concat_ws(',', CASE WHEN missing_values > 0 THEN CASE WHEN "
    "missing_percentage < 5 THEN 'fill_null_mean' WHEN missing_percentage < 20 THEN 'fill_null_median' ELSE "
    "'remove_null' END END, CASE WHEN categorical_columns > 0 THEN CASE WHEN high_cardinality_columns <> '' THEN "
    "'label_encoding' ELSE 'one_hot_encoding' END END, CASE WHEN numeric_columns > 0 AND first_type <> 'none' THEN "
    "'standard_scaling' END, CASE WHEN has_high_correlation THEN 'outlier_removal_iqr' END) AS steps, "
    "concat('Rule-based analysis for ', size_class, ' dataset with ', num_rows, ' rows and ', num_columns, "
    f"' columns.') AS reasoning FROM ({CHARACTERISTICS_SQL}) c"
))
def recommend_models(spark, folder):
    found = rules.recommend_models(_characteristics(spark, folder))
    return found.select(
        "dataset", "analysis_type",
        listed(F.transform("recommended_models", lambda m: F.concat_ws(":", m["model"], m["confidence"].cast("string"))))
        .alias("models"),
        listed(F.transform("recommended_preprocessing", lambda s: s["step"])).alias("steps"),
        "reasoning",
    )


@query("recommendation_texts", (
    "SELECT dataset, CASE first_type WHEN 'classification' THEN CASE WHEN num_rows < 1000 THEN "
    "'logistic_regression (confidence: 80%) - Good baseline for small classification datasets' ELSE "
    "'random_forest (confidence: 85%) - Robust ensemble method for medium to large datasets with mixed features' END "
    "WHEN 'regression' THEN 'random_forest (confidence: 80%) - Robust for regression tasks with non-linear "
    "relationships' ELSE 'kmeans (confidence: 75%) - Standard clustering for discovering groups in the data' END AS "
    f"first_suggestion FROM ({CHARACTERISTICS_SQL}) c"
))
def recommendation_texts(spark, folder):
    found = rules.display_strings(rules.recommend_models(_characteristics(spark, folder)))
    return found.select("dataset", F.get("model_suggestions", F.lit(0)).alias("first_suggestion"))


# --- importance -------------------------------------------------------------

VARIANCES = union_sql([
    f"SELECT {i} AS position, '{c}' AS feature, var_samp(CAST({c} AS DOUBLE)) AS v FROM {LINEITEM.sql} t"
    for i, c in enumerate(NUMERIC)])


@query("variance_importance", (
    "SELECT feature, round(v / sum(v) OVER (), 6) AS importance FROM (" + VARIANCES + ") s"
))
def variance_importance(spark, folder):
    found = charts.variance_importance(LINEITEM.frame(spark, folder))
    return rounded(found.select("feature", "importance"), ["importance"])
