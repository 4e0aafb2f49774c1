"""Running totals over a whole table, and lookups that survive hot keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritab.schema import col
from veritab.session import checkpoint

BUCKET_ROWS = 500_000
MAX_BUCKETS = 4096
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 1_000


def running_totals(
    df: DataFrame,
    key: str,
    totals: dict[str, str],
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add inclusive running sums in the order of ``key``, which must be unique and not null.

    ``totals`` maps each new column to the column it sums. A table that fits one
    bucket is ordered in one window. A larger one is dealt into key ranges and
    written; the sums of the earlier ranges (one row a range, at most
    ``MAX_BUCKETS``, on the driver) are added to the running sums inside each range,
    so no task sees more than its range.
    """
    order = col(key).desc() if descending else col(key).asc()
    rows = df.count()
    if rows <= bucket_rows:
        window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(col(source)).over(window).alias(name) for name, source in totals.items()])

    buckets = min(MAX_BUCKETS, math.ceil(rows / bucket_rows))
    place = _unused("_range", df.columns)
    # Written, so that a range keeps its rows when a lost executor makes Spark repeat a step.
    dealt = checkpoint(df.repartitionByRange(buckets, order).withColumn(place, F.spark_partition_id()))
    sums = {
        row[place]: row
        for row in dealt.groupBy(place).agg(*[F.sum(col(s)).alias(n) for n, s in totals.items()]).collect()
    }
    window = Window.partitionBy(place).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    result = []
    for name, source in totals.items():
        offset, before = {}, 0
        for bucket in sorted(sums):
            offset[bucket] = before
            before += sums[bucket][name]
        offsets = F.array(*[F.lit(offset.get(b, 0)) for b in range(buckets)])
        result.append((F.sum(col(source)).over(window) + F.get(offsets, F.col(place))).alias(name))
    return dealt.select(*[col(c) for c in df.columns], *result)


def _unused(name: str, columns: Sequence[str]) -> str:
    while name in columns:
        name += "_"
    return name


def hashed_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """``rows`` rows of the smallest hashes of ``key`` (all, if there are fewer) out of about ``total``.

    Only rows below a bound on the hash are sorted, about twice as many as wanted,
    so the driver gets as few of them however many partitions there are.
    """
    mixed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    few = total <= 4 * rows
    bound = (1 << 40) if few else math.ceil((2 * rows + 100) / total * (1 << 40))
    return df.filter(mixed < F.lit(bound)).orderBy(mixed, key).limit(rows)


def dense_codes(values: DataFrame, key: str, name: str = "code", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number distinct key values 0, 1, 2, ... in ascending order."""
    ranked = running_totals(values.withColumn("_one", F.lit(1).cast("bigint")), key, {name: "_one"},
                            bucket_rows=bucket_rows)
    return ranked.withColumn(name, F.col(name) - 1).drop("_one")


def _literal(value: object, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return F.array(*[F.lit(v) for v in value]).cast(data_type)
    return F.lit(value).cast(data_type)


def lookup(
    df: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join ``df`` to ``table`` (unique on ``table_key``, ``weight`` = rows of ``df`` per key).

    A table of checked size in rows and bytes is broadcast. Otherwise the
    keys that hold more than one row in ``HOT_SHARE`` (so at most ``HOT_SHARE``
    keys) are broadcast, and only the other rows are shuffled to the join.
    """
    payload = [c for c in table.columns if c not in (table_key, weight)]
    renamed = table.select(col(table_key).alias("_lookup_key"), *[col(c) for c in payload], col(weight).alias("_weight"))

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side.drop("_weight"), col(key) == F.col("_lookup_key"), "left").drop("_lookup_key")

    row_bytes = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    size, total, held = renamed.agg(F.count(F.lit(1)), F.sum("_weight"), row_bytes).first()
    if size <= broadcast_rows and (held or 0) <= BROADCAST_BYTES:
        return joined(df, F.broadcast(renamed))
    limit = max(1, (total or 0) // HOT_SHARE)
    hot = renamed.filter(F.col("_weight") > limit)
    key_type = renamed.schema["_lookup_key"].dataType
    hot_keys = [_literal(row[0], key_type) for row in hot.select("_lookup_key").collect()]
    # Hot rows too large to broadcast leave their join to adaptive execution, which splits skewed partitions.
    small = (hot.agg(row_bytes).first()[0] or 0) <= BROADCAST_BYTES
    if not hot_keys:
        return joined(df, renamed)
    is_hot = F.coalesce(col(key).isin(hot_keys), F.lit(False))
    missing = df.filter(col(key).isNull()).select("*", *[
        F.lit(None).cast(renamed.schema[c].dataType).alias(c) for c in payload
    ])
    return (
        joined(df.filter(is_hot), F.broadcast(hot) if small else hot)
        .unionByName(joined(df.filter(~is_hot & col(key).isNotNull()), renamed.filter(F.col("_weight") <= limit)))
        .unionByName(missing)
    )
