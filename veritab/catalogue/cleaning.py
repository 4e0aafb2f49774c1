"""Cleaning operators and the cleaning chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalogue.base import CUSTOMER, EVENTS, LINEITEM, ORDERS, PART, as_bigint, query, rounded, union_sql
from veritab.operators import cleaning
from veritab.plans.cleaning import run_operations

LINE_KEY = ["l_orderkey", "l_linenumber"]


# --- missing values -----------------------------------------------------------


@query("drop_null_rows", (
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority "
    f"FROM {ORDERS.sql} t WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"
))
def drop_null_rows(spark, folder):
    kept, _ = cleaning.remove_nulls(ORDERS.frame(spark, folder))
    return rounded(kept.drop("o_orderdate"), ["o_totalprice"])


@query("drop_null_columns", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM {ORDERS.sql} t")
def drop_null_columns(spark, folder):
    kept, _ = cleaning.remove_nulls(ORDERS.frame(spark, folder), "drop_columns", threshold=0.25)
    return kept.drop("o_orderdate")


@query("drop_named_columns", "SELECT p_partkey, p_size FROM " + PART.sql + " t")
def drop_named_columns(spark, folder):
    kept, _ = cleaning.remove_nulls(
        PART.frame(spark, folder), "drop_columns", ["p_name", "p_brand", "p_type", "p_retailprice"])
    return kept


def _filled(name, strategy, source, key, columns, values_sql, fill_value=None):
    picked = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), {values_sql(c)}), 6) AS {c}" for c in columns)

    @query(name, f"SELECT {', '.join(key)}, {picked} FROM {source.sql} t")
    def run(spark, folder):
        done, _ = cleaning.fill_nulls(source.frame(spark, folder), strategy, columns, fill_value)
        return rounded(done.select(*key, *columns), columns)

    return run


_filled("fill_mean", "mean", LINEITEM, LINE_KEY, ["l_quantity", "l_tax"],
        lambda c: f"(SELECT avg({c}) FROM {LINEITEM.sql} s)")
_filled("fill_mean_of_integers", "mean", ORDERS, ["o_orderkey"], ["o_custkey", "o_totalprice"],
        lambda c: f"(SELECT avg({c}) FROM {ORDERS.sql} s)")
_filled("fill_median", "median", LINEITEM, LINE_KEY, ["l_quantity", "l_tax"],
        lambda c: f"(SELECT median({c}) FROM {LINEITEM.sql} s)")


@query("fill_mode", (
    "SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM " + ORDERS.sql + " s WHERE "
    "o_orderpriority IS NOT NULL GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS "
    "o_orderpriority, coalesce(o_custkey, (SELECT o_custkey FROM " + ORDERS.sql + " s WHERE o_custkey IS NOT NULL "
    f"GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)) AS o_custkey FROM {ORDERS.sql} t"
))
def fill_mode(spark, folder):
    done, _ = cleaning.fill_nulls(ORDERS.frame(spark, folder), "mode", ["o_orderpriority", "o_custkey"])
    return done.select("o_orderkey", "o_orderpriority", "o_custkey")


@query("fill_constant", (
    "SELECT p_partkey, coalesce(CAST(p_size AS VARCHAR), 'unknown') AS p_size FROM " + PART.sql + " t"
))
def fill_constant(spark, folder):
    done, _ = cleaning.fill_nulls(PART.frame(spark, folder), "constant", ["p_size"], "unknown")
    return done.select("p_partkey", "p_size")


# --- outliers -------------------------------------------------------------------


@query("outlier_iqr", (
    "SELECT event_id, user_id, round(value, 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.75) AS q3 FROM events) b WHERE NOT coalesce(value < q1 - 1.5 * (q3 - q1) OR "
    "value > q3 + 1.5 * (q3 - q1), false)"
))
def outlier_iqr(spark, folder):
    kept, _ = cleaning.remove_outliers(EVENTS.frame(spark, folder), "iqr", ["value"], 1.5)
    return rounded(kept.select("event_id", "user_id", "value"), ["value"])


@query("outlier_iqr_multi", (
    "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, round(l_extendedprice, 6) AS l_extendedprice FROM "
    f"{LINEITEM.sql} t, (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS a3, "
    "quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.75) AS b3, quantile_cont(l_tax, 0.25) "
    f"AS c1, quantile_cont(l_tax, 0.75) AS c3 FROM {LINEITEM.sql} s) b WHERE "
    "NOT coalesce(l_quantity < a1 - 0.4 * (a3 - a1) OR l_quantity > a3 + 0.4 * (a3 - a1), false) AND "
    "NOT coalesce(l_extendedprice < b1 - 0.4 * (b3 - b1) OR l_extendedprice > b3 + 0.4 * (b3 - b1), false) AND "
    "NOT coalesce(l_tax < c1 - 0.4 * (c3 - c1) OR l_tax > c3 + 0.4 * (c3 - c1), false)"
))
def outlier_iqr_multi(spark, folder):
    kept, _ = cleaning.remove_outliers(
        LINEITEM.frame(spark, folder), "iqr", ["l_quantity", "l_extendedprice", "l_tax"], 0.4)
    return rounded(kept.select(*LINE_KEY, "l_quantity", "l_tax", "l_extendedprice"), ["l_extendedprice"])


@query("outlier_zscore", (
    f"SELECT l_orderkey, l_linenumber, l_quantity FROM {LINEITEM.sql} t, (SELECT avg(l_quantity) AS m, "
    f"stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM "
    f"{LINEITEM.sql} u) b WHERE NOT coalesce(abs((l_quantity - m) / s) > 1.6, false) AND "
    "NOT coalesce(abs((l_extendedprice - m2) / s2) > 1.6, false)"
))
def outlier_zscore(spark, folder):
    kept, _ = cleaning.remove_outliers(
        LINEITEM.frame(spark, folder), "zscore", ["l_quantity", "l_extendedprice"], 1.6)
    return kept.select(*LINE_KEY, "l_quantity")


# --- scaling --------------------------------------------------------------------


@query("scale_standard", (
    "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal, round((c_nationkey - m2) / s2, 6) AS c_nationkey "
    f"FROM {CUSTOMER.sql} t, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS m2, "
    f"stddev_pop(c_nationkey) AS s2 FROM {CUSTOMER.sql} u) b"
))
def scale_standard(spark, folder):
    columns = ["c_acctbal", "c_nationkey"]
    done, _ = cleaning.scale(CUSTOMER.frame(spark, folder), "standard", columns)
    return rounded(done.select("c_custkey", *columns), columns)


@query("scale_minmax", (
    "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM "
    f"{CUSTOMER.sql} t, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {CUSTOMER.sql} u) b"
))
def scale_minmax(spark, folder):
    done, _ = cleaning.scale(CUSTOMER.frame(spark, folder), "minmax", ["c_acctbal"])
    return rounded(done.select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("scale_constant", "SELECT c_custkey, 0.0::DOUBLE AS fixed, 0.0::DOUBLE AS same FROM customer")
def scale_constant(spark, folder):
    df = CUSTOMER.frame(spark, folder).select("c_custkey", F.lit(7).alias("fixed"), F.lit(2.5).alias("same"))
    standard, _ = cleaning.scale(df, "standard", ["fixed"])
    done, _ = cleaning.scale(standard, "minmax", ["same"])
    return done


@query("scaling_parameters", union_sql([
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS shift, round(stddev_pop({c}), 6) AS divisor FROM "
    f"{LINEITEM.sql} t" for c in ("l_quantity", "l_discount", "l_tax")]))
def scaling_parameters(spark, folder):
    found = cleaning.fit_scaling(LINEITEM.frame(spark, folder), "standard", ["l_quantity", "l_discount", "l_tax"])
    return rounded(found, ["shift", "divisor"])


# --- encoding -------------------------------------------------------------------


def _codes_sql(relation: str, c: str) -> str:
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM {relation} s WHERE {c} IS NOT NULL GROUP BY {c})"


@query("label_encode", (
    "SELECT o_orderkey, p.code AS o_orderpriority, q.code AS o_orderstatus FROM " + ORDERS.sql + " t LEFT JOIN "
    + _codes_sql(ORDERS.sql, "o_orderpriority") + " p ON p.v = o_orderpriority LEFT JOIN "
    + _codes_sql(ORDERS.sql, "o_orderstatus") + " q ON q.v = o_orderstatus"
))
def label_encode(spark, folder):
    done, _ = cleaning.label_encode(ORDERS.frame(spark, folder), ["o_orderpriority", "o_orderstatus"])
    return done.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("label_encode_placeholder", (
    "SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT NULL THEN code END AS o_orderpriority FROM " + ORDERS.sql
    + " t LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "
    f"coalesce(o_orderpriority, '__MISSING__') AS v FROM {ORDERS.sql} s) d) p ON p.v = o_orderpriority"
))
def label_encode_placeholder(spark, folder):
    done, _ = cleaning.label_encode(ORDERS.frame(spark, folder), ["o_orderpriority"], placeholder_code=True)
    return done.select("o_orderkey", "o_orderpriority")


@query("label_encode_wide", (
    "SELECT event_id, code AS props FROM events LEFT JOIN " + _codes_sql("events", "props") + " p ON p.v = props"
))
def label_encode_wide(spark, folder):
    """A column with many values: codes from several key ranges, and a shuffled join with hot values apart."""
    done, _ = cleaning.label_encode(EVENTS.frame(spark, folder), ["props"], bucket_rows=50, broadcast_rows=50)
    return done.select("event_id", "props")


@query("label_mapping", (
    "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code, n FROM (SELECT o_orderpriority AS value, count(*) AS "
    f"n FROM {ORDERS.sql} t WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority) g"
))
def label_mapping(spark, folder):
    return cleaning.label_mapping(ORDERS.frame(spark, folder), "o_orderpriority")


STATUSES = ["F", "O", "P"]


@query("one_hot", (
    "SELECT o_orderkey, " + ", ".join(
        f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in STATUSES)
    + f" FROM {ORDERS.sql} t"
))
def one_hot(spark, folder):
    done, _ = cleaning.one_hot_encode(ORDERS.frame(spark, folder), ["o_orderstatus"])
    return done.select("o_orderkey", *[f"o_orderstatus_{v}" for v in STATUSES])


FLAGS = ["A", "N", "R"]


@query("one_hot_drop_first", (
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"coalesce(l_returnflag = '{v}', false) AS \"l_returnflag_{v}\"" for v in FLAGS[1:])
    + " FROM lineitem"
))
def one_hot_drop_first(spark, folder):
    done, _ = cleaning.one_hot_encode(LINEITEM.frame(spark, folder), ["l_returnflag"], drop_first=True)
    return done.select(*LINE_KEY, *[f"l_returnflag_{v}" for v in FLAGS[1:]])


# --- the whole chain ------------------------------------------------------------

CHAIN = [
    {"type": "null_filling", "parameters": {"strategy": "mean", "columns": ["o_totalprice", "o_custkey"]}},
    {"operation": "handle_missing", "method": "drop", "columns": ["o_orderpriority"]},
    {"type": "outlier_removal", "parameters": {"method": "zscore", "columns": ["o_totalprice"], "threshold": 1.5}},
    {"type": "no_such_operation", "parameters": {}},
    {"operation": "scale_features", "method": "minmax", "columns": ["o_totalprice"]},
    {"operation": "encode_categorical", "method": "label", "columns": ["o_orderpriority"]},
    {"operation": "encode_categorical", "method": "onehot", "columns": ["o_orderstatus"]},
]
CHAIN_SQL = (
    "WITH filled AS (SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT avg(o_custkey) FROM "
    + ORDERS.sql + " s)) AS o_custkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM " + ORDERS.sql
    + " s)) AS o_totalprice, o_orderstatus, o_orderpriority FROM " + ORDERS.sql + " t), complete AS (SELECT * FROM "
    "filled WHERE o_orderpriority IS NOT NULL), kept AS (SELECT c.* FROM complete c, (SELECT avg(o_totalprice) AS m, "
    "stddev_samp(o_totalprice) AS s FROM complete) b WHERE NOT abs((o_totalprice - m) / s) > 1.5), "
    "codes AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM kept "
    "GROUP BY o_orderpriority) "
)


@query("cleaning_chain", (
    CHAIN_SQL + "SELECT o_orderkey, round(o_custkey, 6) AS o_custkey, round((o_totalprice - lo) / (hi - lo), 6) AS "
    "o_totalprice, code AS o_orderpriority, " + ", ".join(
        f"o_orderstatus = '{v}' AS \"o_orderstatus_{v}\"" for v in STATUSES)
    + " FROM kept JOIN codes ON v = o_orderpriority, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM "
    "kept) r"
))
def cleaning_chain(spark, folder):
    done = run_operations(ORDERS.frame(spark, folder), CHAIN).data
    return rounded(done.drop("o_orderdate"), ["o_custkey", "o_totalprice"])


@query("cleaning_log", (
    CHAIN_SQL + "SELECT * FROM (SELECT CAST(0 AS BIGINT) AS step, 'null_filling' AS action, 'completed' AS status, (SELECT count(*) "
    "FROM filled) AS rows_before, (SELECT count(*) FROM filled) AS rows_after UNION ALL SELECT 1, 'null_removal', "
    "'completed', (SELECT count(*) FROM filled), (SELECT count(*) FROM complete) UNION ALL SELECT 2, 'outlier_removal', "
    "'completed', (SELECT count(*) FROM complete), (SELECT count(*) FROM kept) UNION ALL SELECT 3, 'no_such_operation', "
    "'failed', (SELECT count(*) FROM kept), (SELECT count(*) FROM kept) UNION ALL SELECT 4, 'scaling', 'completed', "
    "(SELECT count(*) FROM kept), (SELECT count(*) FROM kept) UNION ALL SELECT 5, 'label_encoding', 'completed', "
    "(SELECT count(*) FROM kept), (SELECT count(*) FROM kept) UNION ALL SELECT 6, 'one_hot_encoding', 'completed', "
    "(SELECT count(*) FROM kept), (SELECT count(*) FROM kept)) l"
))
def cleaning_log(spark, folder):
    log = run_operations(ORDERS.frame(spark, folder), CHAIN).log
    rows = [(i, e["action"], e["status"], e["rows_before"], e["rows_after"]) for i, e in enumerate(log)]
    return as_bigint(spark.createDataFrame(
        rows, "step bigint, action string, status string, rows_before bigint, rows_after bigint"), ["step"])
