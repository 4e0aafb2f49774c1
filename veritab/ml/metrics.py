"""Evaluation of classifications and clusterings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.ml.vectors import distance_sums, distances_to, feature_array, feature_vector, matrix
from veritab.operators.charts import area_under_curve, prediction_counts, roc_points
from veritab.schema import col
from veritab.session import checkpoint

BLOCK_ROWS = 16384
BROADCAST_CLUSTERS = 100_000


def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None,
                           positive: object | None = None) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, and AUC for two classes with a score.

    Everything but the AUC comes from the confusion counts. A class that is
    never predicted has precision 0.
    """
    counts = prediction_counts(df, label, prediction)
    sides = counts.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("correct")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("correct")),
        )).alias("s")
    ).groupBy("s.class").agg(
        F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"), F.sum("s.correct").alias("correct"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("correct"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("correct"), F.col("actual")), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    total = F.sum("actual")
    metrics = sides.agg(
        F.try_divide(F.sum("correct"), total).alias("accuracy"),
        F.try_divide(F.sum(precision * F.col("actual")), total).alias("precision"),
        F.try_divide(F.sum(recall * F.col("actual")), total).alias("recall"),
        F.try_divide(F.sum(f1 * F.col("actual")), total).alias("f1_score"),
    )
    if score is None:
        return metrics
    classes = [r[0] for r in counts.select("label").distinct().orderBy("label").limit(3).collect()]
    if len(classes) != 2:
        return metrics
    auc = area_under_curve(roc_points(df, label, score, classes[1] if positive is None else positive)).first()["auc"]
    return metrics.withColumn("auc", F.lit(auc).cast("double"))


def silhouette_exact(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean silhouette with Euclidean distance over clustered rows; NULL unless 2 to n-1 clusters.

    Exact. The mean distance of a row to a cluster is at least the distance to its
    centre, and at most that and the cluster's mean distance from its centre. So a
    row opens its own cluster and those that may be the nearest, and no others.
    Who opens a cluster and its members are dealt into blocks, every pair of blocks
    is one task of bounded size, and a task returns distance sums per row, never
    single distances. ``silhouette_squared`` is the linear-time measure.
    """
    rows = df.filter(col(label) != -1).select(
        col(key).alias("id"), col(label).alias("cluster"), feature_array(df, features).alias("x"))
    clusters = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    size, groups = clusters.agg(F.sum("members"), F.count(F.lit(1))).first()
    size = size or 0
    schema = "silhouette_score double"
    if not 2 <= groups <= size - 1:
        return df.sparkSession.createDataFrame([(None,)], schema)
    opened = checkpoint(opened_clusters(rows, groups))
    dealt = (opened.groupBy("opened").agg(F.count(F.lit(1)).alias("asking")).join(
        clusters, F.col("opened") == F.col("cluster")).select(
        F.col("opened").alias("of"), "members", F.ceil(F.col("asking") / block_rows).cast("int").alias("lefts"),
        F.ceil(F.col("members") / block_rows).cast("int").alias("rights")))
    dealt = F.broadcast(dealt) if groups <= BROADCAST_CLUSTERS else dealt

    def block(number: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(number)).cast("int")

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    left = opened.join(dealt, F.col("opened") == F.col("of")).withColumn("left", block("lefts")).withColumn(
        "right", every("rights")).select("of", "left", "right", "id", "cluster", "x")
    right = rows.join(dealt, F.col("cluster") == F.col("of")).withColumn("right", block("rights")).withColumn(
        "left", every("lefts"))
    # Both sides come from one table; new column identities keep the cogroup unambiguous.
    right = right.select(*[F.col(c).alias(c) for c in ("of", "left", "right", "x")])

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "own", "cluster", "total"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        points = matrix(b["x"])
        return pd.DataFrame({
            "id": a["id"], "own": a["cluster"], "cluster": a["of"],
            "total": distance_sums(matrix(a["x"]), points)})[columns]

    id_type = rows.schema["id"].dataType.simpleString()
    cluster_type = rows.schema["cluster"].dataType.simpleString()
    partial = left.groupBy("of", "left", "right").cogroup(right.groupBy("of", "left", "right")).applyInPandas(
        sums, f"id {id_type}, own {cluster_type}, cluster {cluster_type}, total double")
    whole = partial.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"))
    with_sizes = whole.join(F.broadcast(clusters) if groups <= BROADCAST_CLUSTERS else clusters, "cluster")
    mine = F.col("own") == F.col("cluster")
    per_row = with_sizes.groupBy("id", "own").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("members") - 1))).alias("a"),
        F.max(F.when(mine, F.col("members"))).alias("members"),
        F.min(F.when(~mine, F.col("total") / F.col("members"))).alias("b"),
    )
    score = F.when(F.col("members") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_row.agg(F.avg(score).alias("silhouette_score"))


def opened_clusters(rows: DataFrame, groups: int) -> DataFrame:
    """``rows(id, cluster, x)`` once for each cluster they open: their own, and those that may be the nearest other.

    Centres and mean radii come from two aggregations and are sent to all tasks, so
    there may be ``BROADCAST_CLUSTERS`` of them at most.
    """
    if groups > BROADCAST_CLUSTERS:
        raise ValueError(f"an exact silhouette takes {BROADCAST_CLUSTERS} clusters at most, there are {groups}")
    found = {r["cluster"]: r["center"].toArray() for r in rows.select(
        "cluster", array_to_vector("x").alias("v")).groupBy("cluster").agg(
        Summarizer.mean(F.col("v")).alias("center")).collect()}
    names = sorted(found)
    centers = np.array([found[c] for c in names])
    code = {c: i for i, c in enumerate(names)}

    def gaps(x: np.ndarray) -> np.ndarray:
        return np.column_stack([distances_to(x, c) for c in centers])

    def own_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                own = batch["cluster"].map(code).to_numpy()
                yield pd.DataFrame({"cluster": batch["cluster"], "gap": gaps(matrix(batch["x"]))[np.arange(len(own)), own]})

    cluster_type = rows.schema["cluster"].dataType.simpleString()
    spread = {r["cluster"]: r["gap"] for r in rows.select("cluster", "x").mapInPandas(
        own_gaps, f"cluster {cluster_type}, gap double").groupBy("cluster").agg(F.avg("gap").alias("gap")).collect()}
    radius = np.array([spread[c] for c in names])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            own = batch["cluster"].map(code).to_numpy()
            low = gaps(matrix(batch["x"]))
            high = low + radius
            high[np.arange(len(own)), own] = np.inf
            wanted = low <= high.min(axis=1)[:, None] * (1 + 1e-9)
            wanted[np.arange(len(own)), own] = True
            row, cluster = np.nonzero(wanted)
            yield batch.iloc[row].assign(opened=np.array(names, dtype=object)[cluster])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(choose, f"id {types['id']}, cluster {types['cluster']}, x array<double>, opened {types['cluster']}")


def silhouette_squared(df: DataFrame, features: Sequence[str], label: str) -> float:
    """Silhouette with squared Euclidean distance, in one pass over the rows."""
    rows = df.filter(col(label) != -1).select(
        feature_vector(df, features).alias("features"), col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows)


def clustering_metrics(df: DataFrame, features: Sequence[str], label: str, key: str,
                       block_rows: int = BLOCK_ROWS, silhouette: str = "exact") -> DataFrame:
    """One row: clusters without noise, noise rows, and ``silhouette_score`` or ``silhouette_squared``.

    ``silhouette`` chooses the measure: ``exact`` costs the square of the rows,
    ``squared`` (squared Euclidean distance) one pass. Both are NULL unless there
    are 2 to n-1 clusters.
    """
    if silhouette not in ("exact", "squared"):
        raise ValueError(f"unknown silhouette: {silhouette}")
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("label") != -1).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("n"))), F.lit(0)).alias("n_noise_points"),
    )
    if silhouette == "exact":
        score = silhouette_exact(df, features, label, key, block_rows)
    else:
        groups, clustered = df.filter(col(label) != -1).agg(F.count_distinct(col(label)), F.count(F.lit(1))).first()
        value = silhouette_squared(df, features, label) if 2 <= groups <= clustered - 1 else None
        score = df.sparkSession.createDataFrame([(value,)], "silhouette_squared double")
    union = score.unionByName(counts, allowMissingColumns=True)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])
