"""Reproducible stratified split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.schema import col, require_columns

WINDOW_ROWS = 1_000_000
BROADCAST_CLASSES = 10_000


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``is_test``: in every class the ``round(n * test_size)`` rows with the smallest key hash.

    ``key`` must identify a row. A class of any size is cut by hash prefix:
    whole prefixes go to one side by their counts, and only the rows of the one
    prefix that straddles the cut are ordered.
    """
    require_columns(df, [label, key])
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string"))))
    class_sizes = df.groupBy(col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    largest, classes = class_sizes.agg(F.max("_n"), F.count(F.lit(1))).first()
    largest = largest or 0
    wanted = F.floor(F.col("_n") * F.lit(test_size) + 0.5)
    if largest <= window_rows:
        rank = F.row_number().over(Window.partitionBy(col(label)).orderBy("_hash", col(key)))
        size = F.count(F.lit(1)).over(Window.partitionBy(col(label)))
        return (
            hashed.withColumn("_n", size).withColumn("_rank", rank)
            .select(*[col(c) for c in df.columns], (F.col("_rank") <= wanted).alias("is_test"))
        )
    digits = max(1, math.ceil(math.log(largest / window_rows, 16)))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, digits))
    prefixes = hashed.groupBy(col(label).alias("_label"), "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_label").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_label")
    cuts = (
        prefixes.withColumn("_upto", F.sum("_rows").over(earlier)).withColumn("_n", F.sum("_rows").over(whole))
        .withColumn("_left", wanted - (F.col("_upto") - F.col("_rows")))
        .filter((F.col("_left") >= 0) & (F.col("_upto") > wanted))
        .groupBy("_label").agg(F.min(F.struct("_prefix", "_left")).alias("_cut"))
    )
    if classes <= BROADCAST_CLASSES:
        cuts = F.broadcast(cuts)
    # No row lies past the cut when the whole class is wanted; such a class has no cut row.
    marked = hashed.join(cuts, col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    on_cut = F.coalesce(F.col("_prefix") == F.col("_cut._prefix"), F.lit(False))
    rest = marked.filter(~on_cut).select(
        *[col(c) for c in df.columns],
        F.coalesce(F.col("_prefix") < F.col("_cut._prefix"), F.lit(True)).alias("is_test"))
    rank = F.row_number().over(Window.partitionBy(col(label), "_prefix").orderBy("_hash", col(key)))
    straddling = marked.filter(on_cut).withColumn("_rank", rank).select(
        *[col(c) for c in df.columns], (F.col("_rank") <= F.col("_cut._left")).alias("is_test"))
    return rest.unionByName(straddling)
