"""Training drivers: validate, split, fit, predict, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ranking import dense_codes, lookup
from veritab.ml import knn
from veritab.ml.dbscan import dbscan
from veritab.ml.metrics import classification_metrics, clustering_metrics
from veritab.ml.split import stratified_split
from veritab.ml.vectors import feature_array, feature_vector, matrix, spread
from veritab.schema import col, numeric_only, require_columns
from veritab.session import checkpoint

MAX_DEPTH = 30
SIDE_BY_SIDE = 10
SUPERVISED = ("logistic_regression", "random_forest", "knn", "svm")
UNSUPERVISED = ("kmeans", "k-means", "dbscan")


@dataclass
class TrainingResult:
    """``predictions`` holds ``key, label, prediction`` and, for two classes, ``score``."""

    model_type: str
    algorithm: str
    feature_columns: list[str]
    metrics: DataFrame
    predictions: DataFrame
    target_column: str | None = None
    class_table: DataFrame | None = None
    model: Any = None
    importances: list[float] | None = None
    centers: list[list[float]] | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def classes(self) -> list[Any] | None:
        """The classes in ascending order, brought to the driver when asked for."""
        if self.class_table is None:
            return None
        return [row[0] for row in self.class_table.orderBy("code").select("value").collect()]


def default_features(df: DataFrame, target: str | None, key: str) -> list[str]:
    """Supervised: every column but target and key. Unsupervised: every numeric column but the key."""
    if target is not None:
        return [c for c in df.columns if c not in (target, key)]
    return [c for c in numeric_only(df) if c != key]


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """``value, held, code``: the classes numbered from 0 in ascending order, with the rows of each."""
    counted = df.filter(col(target).isNotNull()).groupBy(col(target).alias("value")).agg(
        F.count(F.lit(1)).alias("held"))
    return checkpoint(dense_codes(counted, "value"))


def forest_depth(max_depth: int | None) -> int:
    """None asks for unlimited trees and gets the deepest MLlib can grow; a larger number is an error."""
    if max_depth is None:
        return MAX_DEPTH
    if not 0 < int(max_depth) <= MAX_DEPTH:
        raise ValueError(f"max_depth must lie between 1 and {MAX_DEPTH}")
    return int(max_depth)


def train_supervised(
    df: DataFrame,
    algorithm: str,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    parameters: dict[str, Any] | None = None,
) -> TrainingResult:
    """Split, fit and evaluate a classifier on the rows whose target is known."""
    parameters = dict(parameters or {})
    if algorithm not in SUPERVISED:
        raise ValueError(f"Unsupported supervised algorithm: {algorithm}")
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    require_columns(df, [key])
    features = list(features or default_features(df, target, key))
    depth = forest_depth(parameters.get("max_depth")) if algorithm == "random_forest" else None
    classes = class_codes(df, target)
    groups = classes.count()
    if groups < 2:
        raise ValueError(f"{target} needs at least two classes")
    seed = int(parameters.get("random_state", 42))
    known = df.filter(col(target).isNotNull())
    # Every trainer passes over the rows many times, so the split is made once.
    split = stratified_split(known, target, key, float(parameters.get("test_size", 0.2)), seed)
    codes = classes.select(F.col("value").alias("_class"), F.col("code").alias("_code"), "held")
    coded = checkpoint(lookup(split, target, codes, "_class", "held").select(
        col(key).alias("key"), F.col("_code").cast("double").alias("label"), feature_array(df, features).alias("x"),
        "is_test"))
    train, test = coded.filter(~F.col("is_test")), coded.filter(F.col("is_test"))
    rows, width = train.agg(F.count("x"), F.max(F.size("x"))).first()

    model, importances = None, None
    if algorithm == "knn":
        k = int(parameters.get("n_neighbors", 5))
        voted = knn.knn_predict(train, test, ["x"], "key", "label", k)
        share = F.coalesce(F.try_element_at("votes", F.lit(1.0)), F.lit(0)) / F.aggregate(
            F.map_values("votes"), F.lit(0).cast("bigint"), lambda a, b: a + b)
        scored = test.select("key", "label").join(
            voted.select("key", "prediction", share.alias("score")), "key")
    else:
        with_vector = spread(train, rows, width or 1).withColumn("features", array_to_vector("x"))
        unseen = test.withColumn("features", array_to_vector("x"))
        if algorithm == "svm":
            model = fit_svm(train, parameters, groups, seed)
            scored = model.predict(test)
        else:
            estimator = (
                LogisticRegression(
                    maxIter=int(parameters.get("max_iter", 1000)), regParam=1.0 / max(1, rows),
                    elasticNetParam=0.0, standardization=False)
                if algorithm == "logistic_regression" else
                RandomForestClassifier(
                    numTrees=int(parameters.get("n_estimators", 100)),
                    maxDepth=depth, seed=seed, cacheNodeIds=True)
            )
            if algorithm == "random_forest":
                # Without this mark the forest refuses more than 100 classes.
                nominal = {"ml_attr": {"type": "nominal", "num_vals": groups}}
                with_vector = with_vector.withMetadata("label", nominal)
            model = estimator.fit(with_vector)
            if algorithm == "random_forest":
                importances = [float(v) for v in model.featureImportances.toArray()]
            scored = model.transform(unseen).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    score: list[Column] = [F.col("score")] if groups == 2 else []
    # Metrics and charts read the predictions many times, so they are made once.
    scored = checkpoint(scored.select(
        "key", F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("prediction"),
        *score))
    metrics = classification_metrics(
        scored, "label", "prediction", "score" if score else None, 1 if score else None)
    names = classes.select(F.col("code").alias("_code"), F.col("value").alias("_value"), "held")
    predictions = scored
    for code in ("label", "prediction"):
        predictions = lookup(predictions, code, names, "_code", "held").drop(code).withColumnRenamed("_value", code)
    predictions = checkpoint(predictions.select("key", "label", "prediction", *score))
    extra = {} if depth is None else {"max_depth": depth}
    return TrainingResult("supervised", algorithm, features, metrics, predictions, target, classes, model,
                          importances, extra=extra)


# --- support vector machine -------------------------------------------------


@dataclass
class KernelMap:
    """Random Fourier features of the Gaussian kernel (Rahimi and Recht, 2007)."""

    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, width: int, gamma: float, components: int, seed: int) -> KernelMap:
        generator = np.random.default_rng(seed)
        return cls(generator.normal(0.0, np.sqrt(2.0 * gamma), (width, components)),
                   generator.uniform(0.0, 2.0 * np.pi, components))

    def column(self, x: str) -> Column:
        weights, phases = self.weights, self.phases

        @F.pandas_udf("array<double>")
        def mapped(values: pd.Series) -> pd.Series:
            if values.empty:
                return pd.Series([], dtype=object)
            z = np.cos(matrix(values) @ weights + phases) * np.sqrt(2.0 / len(phases))
            return pd.Series(list(z))

        return mapped(F.col(x))


@dataclass
class SvmModel:
    classifier: Any
    kernel: KernelMap | None
    calibration: Any

    def features(self, df: DataFrame) -> DataFrame:
        x = self.kernel.column("x") if self.kernel else F.col("x")
        return df.withColumn("features", array_to_vector(x))

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.classifier.transform(self.features(df))
        if self.calibration is None:
            return scored
        margin = scored.withColumn("margin", _margin()).drop("rawPrediction", "features")
        fitted = self.calibration.transform(
            margin.withColumn("features", array_to_vector(F.array("margin"))).withColumnRenamed("prediction", "side"))
        return fitted.drop("prediction").withColumnRenamed("side", "prediction").withColumn(
            "score", F.get(vector_to_array("probability"), F.lit(1)))


def _margin() -> Column:
    return F.get(vector_to_array("rawPrediction"), F.lit(1))


def kernel_width(train: DataFrame) -> float:
    """``1 / (width * variance)`` over all feature values, in one aggregation."""
    values = train.select(F.size("x").alias("width"), F.explode("x").alias("v"))
    width, variance = values.agg(F.max("width"), F.var_pop("v")).first()
    return 1.0 / (width * variance) if variance else 1.0


def fit_svm(train: DataFrame, parameters: dict[str, Any], classes: int, seed: int) -> SvmModel:
    """Support vector machine on ``x`` and ``label``.

    The Gaussian kernel is approximated by random Fourier features under a
    linear machine, so training scales with the rows. More than two classes are
    trained one against the rest. Probabilities come from a logistic fit on the
    margin, for two classes.
    """
    kernel_name = parameters.get("kernel", "rbf")
    if kernel_name not in ("rbf", "linear"):
        raise ValueError(f"Unsupported kernel: {kernel_name}")
    kernel = None
    if kernel_name == "rbf":
        width = train.select(F.size("x")).first()[0]
        gamma = parameters.get("gamma", "scale")
        gamma = kernel_width(train) if gamma == "scale" else float(gamma)
        kernel = KernelMap.draw(width, gamma, int(parameters.get("n_components", 256)), seed)
    rows, width = train.agg(F.count("x"), F.max(F.size("x"))).first()
    # The rows are dealt by the width they get in the kernel map.
    train = spread(train, rows, len(kernel.phases) if kernel else width or 1)
    machine = LinearSVC(
        regParam=1.0 / max(1, rows), maxIter=int(parameters.get("max_iter", 100)), standardization=False)
    model = SvmModel(None, kernel, None)
    mapped = model.features(train).select("label", "features")
    if classes > 2:
        model.classifier = OneVsRest(classifier=machine).fit(mapped)
        return model
    model.classifier = machine.fit(mapped)
    margins = model.classifier.transform(mapped).select("label", array_to_vector(F.array(_margin())).alias("features"))
    model.calibration = LogisticRegression(standardization=False).fit(margins)
    return model


# --- clustering -------------------------------------------------------------


def fit_kmeans(vectors: DataFrame, k: int, seed: int = 42, restarts: int = 1, max_iter: int = 300):
    """K-means on ``features``; the best of ``restarts`` seeds by within-cluster cost, the first of equal ones.

    A fit is a long row of short jobs, so several seeds are fitted side by side on the same kept rows.
    """
    rows, width = vectors.agg(F.count("features"), F.max(F.size(vector_to_array("features")))).first()
    vectors = spread(vectors.select("features"), rows, width or 1).persist(StorageLevel.MEMORY_AND_DISK)
    spark = vectors.sparkSession

    def fit(attempt: int):
        return KMeans(k=k, seed=seed + attempt, maxIter=max_iter).fit(vectors)

    try:
        with ThreadPool(min(restarts, SIDE_BY_SIDE)) as pool:
            models = pool.map(inheritable_thread_target(spark)(fit), range(restarts), chunksize=1)
        return min(models, key=lambda model: model.summary.trainingCost)
    finally:
        vectors.unpersist()


def train_unsupervised(
    df: DataFrame,
    algorithm: str,
    key: str,
    features: Sequence[str] | None = None,
    parameters: dict[str, Any] | None = None,
) -> TrainingResult:
    """Cluster the rows and evaluate the clusters; ``predictions`` holds ``key, label``.

    The parameter ``silhouette`` is ``exact`` (quadratic in the rows of a cluster) or ``squared`` (linear).
    """
    parameters = dict(parameters or {})
    if algorithm not in UNSUPERVISED:
        raise ValueError(f"Unsupported unsupervised algorithm: {algorithm}")
    require_columns(df, [key])
    features = list(features or default_features(df, None, key))
    rows = checkpoint(df.select(col(key).alias("key"), feature_array(df, features).alias("x")))
    centers, model = None, None
    if algorithm == "dbscan":
        labelled = dbscan(rows, ["x"], "key", float(parameters.get("eps", 0.5)), int(parameters.get("min_samples", 5)))
    else:
        vectors = rows.withColumn("features", array_to_vector("x"))
        model = fit_kmeans(vectors, int(parameters.get("n_clusters", 3)), int(parameters.get("random_state", 42)),
                           int(parameters.get("n_init", 10)))
        centers = [[float(v) for v in c] for c in model.clusterCenters()]
        labelled = model.transform(vectors).select("key", "x", F.col("prediction").cast("bigint").alias("label"))
    labelled = checkpoint(labelled)
    metrics = clustering_metrics(
        labelled, ["x"], "label", "key", silhouette=parameters.get("silhouette", "exact"))
    return TrainingResult(
        "unsupervised", algorithm, features, metrics, labelled.select("key", "label"), model=model, centers=centers)


def auto_cluster(
    df: DataFrame,
    key: str,
    x: str | None = None,
    y: str | None = None,
    clusters: int = 3,
    restarts: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Points and centres of a cluster plot when no labels are given.

    Rows with a missing number are dropped, all numeric columns are standard
    scaled, and the centres are brought back to the original units.
    """
    from veritab.operators.cleaning import apply_scaling, fit_scaling

    numeric = [c for c in numeric_only(df) if c != key]
    if len(numeric) < 2:
        raise ValueError("a cluster plot needs two numeric columns")
    x, y = x or numeric[0], y or next(c for c in numeric if c != (x or numeric[0]))
    complete = df.select(col(key), *[col(c) for c in numeric]).dropna(subset=numeric)
    scaling = fit_scaling(complete, "standard", numeric)
    fitted = {r["column"]: (r["shift"], r["divisor"]) for r in scaling.collect()}
    scaled = apply_scaling(complete, df.sparkSession.createDataFrame(
        [(c, *fitted[c]) for c in numeric], scaling.schema))
    if complete.limit(clusters).count() < clusters:
        raise ValueError("fewer rows than clusters")
    vectors = checkpoint(scaled.select(col(key).alias("key"), feature_vector(scaled, numeric).alias("features")))
    model = fit_kmeans(vectors, clusters, seed, restarts)

    def unscaled(name: str) -> Column:
        value = F.get(vector_to_array("features"), F.lit(numeric.index(name)))
        return value * fitted[name][1] + fitted[name][0]

    points = model.transform(vectors).select(
        "key", unscaled(x).alias("x"), unscaled(y).alias("y"), F.col("prediction").alias("label"))
    centers = df.sparkSession.createDataFrame(
        [
            (i, *[float(c[numeric.index(n)] * fitted[n][1] + fitted[n][0]) for n in (x, y)])
            for i, c in enumerate(model.clusterCenters())
        ], "label int, x double, y double")
    return points, centers
