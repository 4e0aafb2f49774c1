"""Registry of queries, and table sources that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.schema import col
from veritab.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Source:
    """A test table with NULLs put in: ``nulls`` maps a column to m, NULL where ``key % m = 0``.

    The test tables have no NULLs of their own. ``types`` lists the columns used
    and their logical types.
    """

    name: str
    key: str
    types: dict[str, str]
    nulls: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def of(self, *kinds: str) -> list[str]:
        return [c for c, kind in self.types.items() if kind in kinds]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, self.name)
        return df.select(*[
            F.when(col(self.key) % self.nulls[c] != 0, col(c)).alias(c) if c in self.nulls else col(c)
            for c in self.columns
        ])

    @property
    def sql(self) -> str:
        parts = [
            f"CASE WHEN {self.key} % {self.nulls[c]} = 0 THEN NULL ELSE {c} END AS {c}" if c in self.nulls else c
            for c in self.columns
        ]
        return f"(SELECT {', '.join(parts)} FROM {self.name})"


LINEITEM = Source("lineitem", "l_orderkey", {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
    "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
    "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime",
}, {"l_quantity": 7, "l_tax": 11})
ORDERS = Source("orders", "o_orderkey", {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "categorical", "o_totalprice": "float",
    "o_orderdate": "datetime", "o_orderpriority": "categorical",
}, {"o_totalprice": 3, "o_orderpriority": 5, "o_custkey": 13})
CUSTOMER = Source("customer", "c_custkey", {
    "c_custkey": "integer", "c_name": "categorical", "c_nationkey": "integer", "c_acctbal": "float",
    "c_mktsegment": "categorical",
}, {"c_acctbal": 4})
PART = Source("part", "p_partkey", {
    "p_partkey": "integer", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical",
    "p_size": "integer", "p_retailprice": "float",
}, {"p_size": 2})
LABELS = Source("labels", "doc_id", {"doc_id": "integer", "quality": "integer", "toxic": "integer"})
EVENTS = Source("events", "event_id", {
    "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "categorical", "value": "float",
    "props": "categorical",
})
SUPPLIER = Source("supplier", "s_suppkey", {
    "s_suppkey": "integer", "s_name": "categorical", "s_nationkey": "integer", "s_acctbal": "float",
})


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(col(c), places) for c in columns})


def as_bigint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: col(c).cast("bigint") for c in columns})


def listed(column: str | Column) -> Column:
    """An array of names as one text, the form both engines compare."""
    return F.array_join(column, ",")


def percent_sql(part: str, whole: str) -> str:
    return f"coalesce(round_even(CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100.0, 2), 0.0)"


def union_sql(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)
