"""The data behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ranking import BUCKET_ROWS, running_totals
from veritab.schema import as_double, col, numeric_only, require_columns


def prediction_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)`` for the pairs that occur."""
    require_columns(df, [label, prediction])
    return (
        df.groupBy(col(label).alias("label"), col(prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, grid: bool = False) -> DataFrame:
    """``(label, prediction, n)`` for the pairs that occur.

    With ``grid`` pairs of labels seen on either side that never occur are added
    with 0, so the result has the square of the number of labels in rows.
    """
    counts = prediction_counts(df, label, prediction)
    if not grid:
        return counts
    seen = counts.select(F.struct("label").alias("c")).union(counts.select(F.struct(F.col("prediction").alias("label"))))
    axis = seen.distinct().agg(F.collect_list("c").alias("axis"))
    pairs = axis.select(F.explode("axis").alias("l"), "axis").select(
        F.col("l.label").alias("label"), F.explode("axis").alias("p")).select(
        "label", F.col("p.label").alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(pairs).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def roc_points(
    df: DataFrame,
    label: str,
    score: str,
    positive: object = 1,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One point per distinct score, from the highest down: ``threshold, tp, fp, tpr, fpr``.

    Rows are folded to one per score first; the running counts over scores are
    computed range by range, so the result may have any size.
    """
    require_columns(df, [label, score])
    is_positive = col(label) == F.lit(positive)
    folded = (
        df.filter(col(score).isNotNull() & col(label).isNotNull())
        .groupBy(as_double(score).alias("threshold"))
        .agg(F.count_if(is_positive).alias("_pos"), F.count_if(~is_positive).alias("_neg"))
    )
    running = running_totals(folded, "threshold", {"tp": "_pos", "fp": "_neg"}, descending=True, bucket_rows=bucket_rows)
    totals = folded.agg(F.sum("_pos"), F.sum("_neg")).first()
    positives, negatives = (totals[0] or 0), (totals[1] or 0)
    return running.select(
        "threshold", "tp", "fp", F.col("_pos").alias("positives_here"), F.col("_neg").alias("negatives_here"),
        F.try_divide(F.col("tp"), F.lit(float(positives))).alias("tpr"),
        F.try_divide(F.col("fp"), F.lit(float(negatives))).alias("fpr"),
    )


def area_under_curve(points: DataFrame) -> DataFrame:
    """Trapezoid area below ``roc_points``: each score adds its own step, no neighbour is needed."""
    step = F.col("negatives_here") * (F.col("tp") - F.col("positives_here") / 2)
    return points.agg(
        F.try_divide(F.sum(step), (F.max("tp") * F.max("fp")).cast("double")).alias("auc"))


def cluster_scatter(
    df: DataFrame,
    label: str,
    x: str | None = None,
    y: str | None = None,
) -> DataFrame:
    """``(x, y, label)`` from two numeric columns, by default the first two."""
    numeric = [c for c in numeric_only(df) if c != label]
    if x is None or y is None:
        if len(numeric) < 2:
            raise ValueError("a cluster plot needs two numeric columns")
        x, y = x or numeric[0], y or next(c for c in numeric if c != (x or numeric[0]))
    require_columns(df, [x, y, label])
    return df.select(as_double(x).alias("x"), as_double(y).alias("y"), col(label).alias("label"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per cluster; label -1 is noise."""
    return (
        df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .select("label", F.when(F.col("label") == -1, "Noise")
                .otherwise(F.concat(F.lit("Cluster "), F.col("label").cast("string"))).alias("name"), "n")
    )


def _ranked(entries: DataFrame) -> DataFrame:
    """Descending importance; equal importances list the later feature first."""
    return entries.orderBy(F.desc("importance"), F.desc("position"))


def variance_importance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each numeric column's share of the summed sample variances; equal shares when all are 0."""
    columns = numeric_only(df, columns)
    if not columns:
        raise ValueError("feature importance needs a numeric column")
    wide = df.agg(*[F.var_samp(as_double(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    total: Column = sum((F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in range(len(columns))), F.lit(0.0))
    return _ranked(wide.select(total.alias("total"), "*").select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("feature"),
            F.when(F.col("total") > 0, F.coalesce(F.col(f"v{i}"), F.lit(0.0)) / F.col("total")).otherwise(1.0 / len(columns))
            .alias("importance"),
        ) for i, c in enumerate(columns)
    ]))))


def given_importance(spark, features: Sequence[str], importances: Sequence[float]) -> DataFrame:
    """The same table from values a model already holds."""
    if len(features) != len(importances):
        raise ValueError("one importance per feature is needed")
    rows = [(i, f, float(v)) for i, (f, v) in enumerate(zip(features, importances))]
    return _ranked(spark.createDataFrame(rows, "position int, feature string, importance double"))
