"""Exact k-nearest-neighbour classification without a cross join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.functions.ranking import hashed_sample
from veritab.ml.vectors import distances_to, feature_array, matrix
from veritab.schema import col

BLOCK_ROWS = 4096
CELL_ROWS = 512
MAX_PIVOTS = 1024
# Distances are compared with this relative slack, so rounding never prunes a true neighbour.
SLACK = 1e-9


def nearest_neighbors(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(key, neighbor, label, distance, rank)``: the ``k`` nearest training rows of each test row.

    Training rows are assigned to the nearest of a bounded set of pivots. From
    the radius and size of each cell a test row gets an upper bound of its k-th
    distance, and it visits only the cells that can hold something nearer. Cells
    are split into blocks of bounded size on both sides, one task compares two
    blocks and returns at most ``k`` rows per test row. Ties go to the smaller key.
    """
    points = train.select(
        col(key).alias("neighbor"), col(label).alias("label"), feature_array(train, features).alias("x"))
    queries = test.select(col(key).alias("key"), feature_array(test, features).alias("q"))
    # Of identical rows only the k with the smallest keys can be neighbours, so copies never fill a cell.
    copies = F.row_number().over(Window.partitionBy("x").orderBy("neighbor"))
    points = points.withColumn("_copy", copies).filter(F.col("_copy") <= k).drop("_copy")
    rows = points.count()
    pivot_count = min(MAX_PIVOTS, max(1, rows // min(CELL_ROWS, block_rows)))
    sample = hashed_sample(points.select("neighbor", "x"), F.col("neighbor"), pivot_count, rows).select("x").collect()
    pivots = matrix([row["x"] for row in sample])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = matrix(batch["x"])
            gaps = np.column_stack([distances_to(x, p) for p in pivots])
            cell = gaps.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), gap=gaps[np.arange(len(x)), cell])

    point_types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    placed = points.mapInPandas(
        assign, f"neighbor {point_types['neighbor']}, label {point_types['label']}, x array<double>, cell int, gap double")
    stats = {
        r["cell"]: r for r in placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("gap").alias("outer"), F.min("gap").alias("inner")).collect()
    }
    cells = sorted(stats)
    sizes = np.array([stats[c]["n"] for c in cells])
    outer = np.array([stats[c]["outer"] for c in cells])
    inner = np.array([stats[c]["inner"] for c in cells])
    used = pivots[cells]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            chosen = []
            for q in matrix(batch["q"]):
                gap = distances_to(used, q)
                reach = gap + outer
                order = reach.argsort(kind="stable")
                enough = np.searchsorted(sizes[order].cumsum(), k)
                bound = reach[order[min(enough, len(order) - 1)]] * (1 + SLACK)
                nearest = np.maximum(gap - outer, inner - gap) * (1 - SLACK)
                chosen.append([cells[i] for i in np.flatnonzero(nearest <= bound)])
            yield batch.assign(cells=chosen)

    query_type = queries.schema["key"].dataType.simpleString()
    # The copies per visited cell are made row by row in the engine, not in a task's frame.
    visits = queries.mapInPandas(visit, f"key {query_type}, q array<double>, cells array<int>").select(
        "key", "q", F.explode("cells").alias("cell"))
    visit_counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(counts: dict[int, int]) -> list[int]:
        return [max(1, math.ceil(counts.get(c, 0) / block_rows)) for c in range(pivot_count)]

    train_blocks = F.get(F.array(*[F.lit(b) for b in blocks({c: stats[c]["n"] for c in cells})]), F.col("cell"))
    test_blocks = F.get(F.array(*[F.lit(b) for b in blocks(visit_counts)]), F.col("cell"))

    def deal(df: DataFrame, mine: str, own: str, own_blocks, other: str, other_blocks) -> DataFrame:
        return (
            df.withColumn(own, F.pmod(F.xxhash64(mine), own_blocks).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1)))
        )

    left = deal(visits, "key", "test_block", test_blocks, "train_block", train_blocks)
    right = deal(placed, "neighbor", "train_block", train_blocks, "test_block", test_blocks)
    # Both sides may come from one table; new column identities keep the cogroup unambiguous.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def compare(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "neighbor", "label", "distance"]
        if tests.empty or trains.empty:
            return pd.DataFrame({c: [] for c in columns})
        trains = trains.sort_values("neighbor", kind="stable")
        x, names, labels = matrix(trains["x"]), trains["neighbor"].to_numpy(), trains["label"].to_numpy()
        picked, found = [], []
        for q in matrix(tests["q"]):
            gap = distances_to(x, q)
            if len(gap) > k:
                limit = np.partition(gap, k - 1)[k - 1]
                near = np.flatnonzero(gap <= limit)
            else:
                near = np.arange(len(gap))
            near = near[gap[near].argsort(kind="stable")][:k]
            picked.append(near)
            found.append(gap[near])
        lengths = [len(p) for p in picked]
        index = np.concatenate(picked)
        return pd.DataFrame({
            "key": np.repeat(tests["key"].to_numpy(), lengths), "neighbor": names[index], "label": labels[index],
            "distance": np.concatenate(found),
        })[columns]

    names = ["cell", "train_block", "test_block"]
    candidates = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(
        compare,
        f"key {query_type}, neighbor {point_types['neighbor']}, label {point_types['label']}, distance double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "neighbor"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(neighbors: DataFrame) -> DataFrame:
    """``(key, prediction, vote_share, votes)``: majority label, ties to the lowest label."""
    counted = neighbors.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "label")
    return counted.groupBy("key").agg(
        F.min_by("label", order).alias("prediction"),
        (F.max("n") / F.sum("n")).alias("vote_share"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("votes"),
    )


def knn_predict(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, label: str, k: int = 5,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    return vote(nearest_neighbors(train, test, features, key, label, k, block_rows))
