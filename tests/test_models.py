import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veritab.catalogue.models import document_features
from veritab.ml import knn, metrics, models
from veritab.ml.dbscan import dbscan
from veritab.ml.split import stratified_split
from veritab.operators import charts
from veritab.ml.vectors import TASK_VALUES, distance_sums, distances_to, spread


def points(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    rows = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "key bigint, x array<double>, label int")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def plain_dbscan(x, eps, min_samples):
    near = distances(x) <= eps
    core = near.sum(1) >= min_samples
    labels, cluster = np.full(len(x), -1), 0
    for start in range(len(x)):
        if labels[start] != -1 or not core[start]:
            continue
        labels[start], waiting = cluster, [start]
        while waiting:
            row = waiting.pop()
            if core[row]:
                for other in np.flatnonzero(near[row] & (labels == -1)):
                    labels[other] = cluster
                    waiting.append(other)
        cluster += 1
    return labels


def blobs(seed=0):
    g = np.random.default_rng(seed)
    return np.vstack([g.normal(0, 0.3, (50, 2)), g.normal(3, 0.3, (50, 2)), g.uniform(-2, 5, (40, 2))])


def crowded():
    """Two crowded places just out of reach, a third of all points each, plus scattered points."""
    return np.vstack([blobs()[:90], np.zeros((80, 2)), np.tile([0.49, 0.0], (80, 1))])


CASES = {
    "plane": (blobs(), 0.5, 5, {}),
    "small parts": (crowded(), 0.3, 5, {"hot_rows": 20, "direct_pairs": 4}),
    "line": (np.random.default_rng(1).uniform(0, 60, (120, 1)), 0.5, 3, {}),
    "space": (np.random.default_rng(2).uniform(0, 3, (80, 6)), 1.2, 3, {}),
}


@pytest.mark.parametrize("case", CASES)
def test_dbscan_like_brute_force(spark, case):
    x, eps, min_samples, options = CASES[case]
    got = dbscan(points(spark, x), ["x"], "key", eps, min_samples, **options).orderBy("key").collect()
    assert [r["label"] for r in got] == plain_dbscan(x, eps, min_samples).tolist()


def test_dbscan_only_noise(spark):
    got = dbscan(points(spark, np.arange(5.0)[:, None] * 10), ["x"], "key", 0.5, 2)
    assert {r["label"] for r in got.collect()} == {-1}


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_neighbors_like_brute_force(spark, block_rows):
    g = np.random.default_rng(3)
    x = np.vstack([g.normal(0, 1, (80, 2)), np.zeros((40, 2)), g.normal(8, 0.2, (30, 2))])
    df = points(spark, x, g.integers(0, 3, len(x)))
    test = df.filter("key % 4 = 0")
    train = df.filter("key % 4 <> 0")
    got = knn.nearest_neighbors(train, test, ["x"], "key", "label", 5, block_rows)
    found = {k: list(g["neighbor"]) for k, g in got.toPandas().sort_values(["key", "rank"]).groupby("key")}
    keys = np.arange(len(x))
    rest = keys[keys % 4 != 0]
    gaps = distances(x)
    for k in keys[keys % 4 == 0]:
        assert found[k] == sorted(rest, key=lambda other: (gaps[k, other], other))[:5]


def test_vote_ties_go_to_the_lowest_label(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (1, 0), (1, 1)], "key int, label int")
    row = knn.vote(df).first()
    assert (row["prediction"], row["vote_share"], row["votes"]) == (0, 0.4, {0: 2, 1: 1, 2: 2})


@pytest.mark.parametrize("block_rows", [4096, 13])
def test_silhouette_like_brute_force(spark, block_rows):
    g = np.random.default_rng(4)
    x, labels = g.normal(0, 1, (60, 3)), np.r_[g.integers(0, 3, 58), 7, -1]
    got = metrics.silhouette_exact(points(spark, x, labels), ["x"], "label", "key", block_rows).first()[0]
    keep = labels != -1
    gaps, kept = distances(x[keep]), labels[keep]
    scores = []
    for i, own in enumerate(kept):
        if (kept == own).sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i][kept == own].sum() / ((kept == own).sum() - 1)
        b = min(gaps[i][kept == c].mean() for c in set(kept) - {own})
        scores.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(scores))


def test_silhouette_needs_two_clusters(spark):
    assert metrics.silhouette_exact(points(spark, np.eye(4)), ["x"], "label", "key").first()[0] is None


@pytest.mark.parametrize("window_rows", [10**6, 7])
def test_split_is_exact_per_class(spark, window_rows):
    df = spark.range(700).select("id", F.when(F.col("id") < 400, "big").when(F.col("id") < 690, "mid").otherwise("few")
                                 .alias("y"))
    split = stratified_split(df, "y", "id", 0.2, window_rows=window_rows)
    counts = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {"big": (400, 80), "mid": (290, 58), "few": (10, 2)}
    same = stratified_split(df, "y", "id", 0.2).filter("is_test").select("id")
    assert split.filter("is_test").select("id").exceptAll(same).isEmpty()


@pytest.mark.parametrize("size", [0.0, 1.0])
def test_split_extremes(spark, size):
    split = stratified_split(spark.range(50).withColumn("y", F.lit(1)), "y", "id", size, window_rows=5)
    assert split.count() == 50
    assert split.filter("is_test").count() == 50 * size


@pytest.fixture(scope="module")
def rings(spark):
    g = np.random.default_rng(5)
    angle, radius = g.uniform(0, 2 * np.pi, 240), np.r_[g.uniform(0, 1, 120), g.uniform(2, 3, 120)]
    frame = pd.DataFrame({"id": range(240), "a": radius * np.cos(angle), "b": radius * np.sin(angle),
                          "y": ["in"] * 120 + ["out"] * 120})
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("algorithm", models.SUPERVISED)
def test_classifiers(rings, algorithm):
    result = models.train_supervised(rings, algorithm, "y", "id", parameters={"n_estimators": 10, "max_depth": 5})
    row = result.metrics.first().asDict()
    assert set(row) == {"accuracy", "precision", "recall", "f1_score", "auc"}
    assert all(0 <= v <= 1 for v in row.values())
    assert result.classes == ["in", "out"] and result.feature_columns == ["a", "b"]
    assert result.predictions.count() == 48
    if algorithm != "logistic_regression":
        assert row["accuracy"] > 0.9
    if algorithm == "random_forest":
        assert sum(result.importances) == pytest.approx(1)


def test_linear_kernel_fails_on_rings(rings):
    result = models.train_supervised(rings, "svm", "y", "id", parameters={"kernel": "linear"})
    assert result.metrics.first()["accuracy"] < 0.8


def test_many_classes(spark):
    g = np.random.default_rng(6)
    frame = pd.DataFrame({"id": range(120), "a": np.repeat([0, 5, 10], 40) + g.normal(0, 0.4, 120),
                          "b": g.normal(0, 1, 120), "y": np.repeat([2, 4, 9], 40)})
    for algorithm in ("svm", "logistic_regression"):
        result = models.train_supervised(spark.createDataFrame(frame), algorithm, "y", "id", ["a", "b"])
        assert result.metrics.first()["accuracy"] > 0.9 and "auc" not in result.metrics.columns
        assert {r["prediction"] for r in result.predictions.collect()} <= {2, 4, 9}


def test_class_count_changes_nothing(spark):
    for groups in (1000, 1001):
        df = spark.range(2 * groups).select("id", (F.col("id") % groups).alias("y"), (F.col("id") % groups * 1.0).alias("a"))
        result = models.train_supervised(df, "knn", "y", "id", ["a"], {"n_neighbors": 1, "test_size": 0.5})
        assert result.predictions.count() > 0 and len(result.classes) == groups
        pairs = charts.confusion_matrix(df.withColumn("p", F.col("y")), "y", "p")
        assert pairs.count() == groups


def test_forest_with_many_classes(spark):
    df = spark.range(1200).select("id", (F.col("id") % 120).alias("y"), (F.col("id") % 120 * 1.0).alias("a"))
    result = models.train_supervised(df, "random_forest", "y", "id", ["a"], {"n_estimators": 2, "max_depth": 9})
    assert result.extra["max_depth"] == 9 and result.metrics.first()["accuracy"] > 0.2
    with pytest.raises(ValueError):
        models.train_supervised(df, "random_forest", "y", "id", ["a"], {"max_depth": 31})


def test_confusion_grid_with_nulls(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", None)], "y string, p string")
    got = {(r["label"], r["prediction"]): r["n"] for r in charts.confusion_matrix(df, "y", "p", grid=True).collect()}
    assert len(got) == 16 and sum(got.values()) == 3 and got["c", None] == 1 and got["b", "c"] == 0


def test_clusterings(spark):
    df = points(spark, blobs()[:100]).select("key", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    means = models.train_unsupervised(df, "kmeans", "key", parameters={"n_clusters": 2})
    assert means.feature_columns == ["a", "b"] and len(means.centers) == 2
    linear = models.train_unsupervised(df, "kmeans", "key", parameters={"n_clusters": 2, "silhouette": "squared"})
    assert linear.metrics.first()["silhouette_squared"] > 0.9
    assert means.metrics.first()["n_clusters"] == 2 and means.metrics.first()["silhouette_score"] > 0.7
    dense = models.train_unsupervised(df, "dbscan", "key", parameters={"eps": 0.8})
    assert dense.metrics.first()["n_clusters"] == 2


def test_bad_requests(rings):
    for call in (
        lambda: models.train_supervised(rings, "nope", "y", "id"),
        lambda: models.train_supervised(rings, "knn", "nope", "id"),
        lambda: models.train_unsupervised(rings, "nope", "id"),
        lambda: models.train_supervised(rings.withColumn("t", F.lit("text")), "knn", "y", "id"),
    ):
        with pytest.raises(ValueError):
            call()


def test_auto_cluster(spark):
    df = spark.createDataFrame([(i, float(i), float(i + 3)) for i in range(1, 11)], "key int, x double, y double")
    shown, centers = models.auto_cluster(df, "key", restarts=2)
    assert shown.count() == 10 and centers.count() == 3
    got = shown.orderBy("key").first()
    assert (got["x"], got["y"]) == (pytest.approx(1.0), pytest.approx(4.0))
    with pytest.raises(ValueError):
        models.auto_cluster(df.limit(2), "key")


def test_metrics_and_charts(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9), (1, 0, 0.2)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    got = metrics.classification_metrics(df, "y", "p", "s").first()
    assert got["accuracy"] == pytest.approx(0.6)
    assert got["precision"] == pytest.approx(0.5 * 0.4 + 2 / 3 * 0.6)
    assert got["auc"] == pytest.approx((1 + 0.5 + 1 + 1 + 1 + 0) / 6)
    grid = {(r["label"], r["prediction"]): r["n"] for r in charts.confusion_matrix(df, "y", "p").collect()}
    assert grid == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    small = charts.area_under_curve(charts.roc_points(df, "y", "s", bucket_rows=1)).first()["auc"]
    assert small == pytest.approx(got["auc"])


def test_importance_order(spark):
    order = [r["feature"] for r in charts.given_importance(spark, ["a", "b", "c"], [0.2, 0.6, 0.2]).collect()]
    assert order == ["b", "c", "a"]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, b double")
    assert [r["importance"] for r in charts.variance_importance(flat).collect()] == [0.5, 0.5]
    noise = spark.createDataFrame([(-1,), (0,), (0,)], "label int")
    assert {r["name"]: r["n"] for r in charts.cluster_sizes(noise, "label").collect()} == {"Noise": 1, "Cluster 0": 2}


def test_silhouette_opens_near_clusters_only(spark):
    rng = np.random.default_rng(8)
    centers = rng.uniform(-500, 500, (12, 3))
    x = np.concatenate([c + rng.normal(size=(40, 3)) for c in centers])
    labels = np.repeat(np.arange(12), 40)
    rows = points(spark, x, labels).selectExpr("key AS id", "label AS cluster", "x")
    opened = metrics.opened_clusters(rows, 12)
    # All of 480 rows against 12 clusters would be 5760 pairs.
    assert 2 * 480 <= opened.count() < 3 * 480
    assert opened.filter("cluster = opened").count() == 480


@pytest.mark.parametrize("width", [2, 64])
def test_distance_sums_keep_their_digits(width):
    """Sums by matrix products equal sums by difference, also far from the origin and for copies."""
    chance = np.random.default_rng(5)
    ones, points = chance.normal(size=(2, 300, width)) + 1e4
    points[:40] = ones[:40]
    points[40:60] = ones[:20] + 1e-7
    wanted = [distances_to(points, one).sum() for one in ones]
    assert np.allclose(distance_sums(ones, points, 7, 50), wanted, rtol=1e-9, atol=0)
    assert distance_sums(np.repeat(ones[:1], 9, 0), np.repeat(ones[:1], 9, 0)).max() == 0


def one_task(spark, rows, width):
    return spark.range(0, rows, 1, 1).select(
        F.col("id").alias("key"), F.array(*[F.rand(i) for i in range(width)]).alias("x"),
        (F.col("id") % 2).cast("double").alias("label"))


def test_spread_bounds_tasks(spark):
    small, large = one_task(spark, 500, 2), one_task(spark, 40_000, 2)
    assert spread(small, 500, 2).rdd.getNumPartitions() == 1
    assert spread(large, 40_000, 2).rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism)
    assert spread(small, 10 * TASK_VALUES, 2).rdd.getNumPartitions() == 20
    assert spread(large, 40_000, 2).count() == 40_000


def test_kmeans_rows_are_dealt(spark, monkeypatch):
    """A table that one task reads is fitted by several, seeds side by side, and the best seed is returned."""
    seen, fit = [], models.KMeans.fit
    monkeypatch.setattr(models.KMeans, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = one_task(spark, 40_000, 2).select(array_to_vector("x").alias("features"))
    best = models.fit_kmeans(rows, 3, restarts=3, max_iter=5)
    assert len(seen) == 3 and min(seen) > 1
    assert len(best.clusterCenters()) == 3


@pytest.mark.parametrize("algorithm, fitted", [("random_forest", "RandomForestClassifier"), ("svm", "LinearSVC")])
def test_training_rows_are_dealt(spark, monkeypatch, algorithm, fitted):
    seen, kind = [], getattr(models, fitted)
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    models.train_supervised(one_task(spark, 40_000, 2), algorithm, "label", "key", ["x"], parameters={
        "n_estimators": 1, "max_depth": 2, "max_iter": 1, "n_components": 256})
    assert seen and min(seen) > 1


def test_texts_stay_out_of_the_join(spark, tmp_path):
    """Labelled documents meet their labels as numbers; a document without a label is not judged."""
    texts = [(1, "Two 22 words!", 13), (2, "no label", 0), (3, None, 4)]
    spark.createDataFrame(texts, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = document_features(spark, str(tmp_path))
    assert [tuple(row) for row in found.orderBy("doc_id").collect()] == [
        (1, 1, pytest.approx(np.log1p(13)), pytest.approx(np.log1p(3)), 2 / 13, 1 / 13, 1 / 13),
        (3, 0, pytest.approx(np.log1p(4)), None, None, None, None)]
    waiting, sides = [found._jdf.queryExecution().optimizedPlan()], []
    while waiting:
        node = waiting.pop()
        below = [node.children().apply(i) for i in range(node.children().length())]
        sides += [side.output().mkString(" ") for side in below if node.nodeName() == "Join"]
        waiting += below
    assert len(sides) == 2 and not any("text" in side for side in sides)
