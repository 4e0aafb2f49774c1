"""Split, evaluation, classifiers and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalogue.base import LINEITEM, SUPPLIER, as_bigint, query, rounded, table
from veritab.ml import knn, metrics
from veritab.ml.dbscan import dbscan
from veritab.ml.models import auto_cluster, train_supervised, train_unsupervised
from veritab.ml.split import stratified_split
from veritab.operators import charts
from veritab.operators.cleaning import scale

# --- split ------------------------------------------------------------------


def split_sql(relation: str, label: str, key: str) -> str:
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat('42|', {key})), {key}) <= "
        f"floor(count(*) OVER (PARTITION BY {label}) * 0.2 + 0.5) AS is_test FROM {relation})")


@query("stratified_split", f"SELECT doc_id, quality, is_test FROM {split_sql('labels', 'quality', 'doc_id')} s")
def split_whole(spark, folder):
    return stratified_split(table(spark, folder, "labels"), "quality", "doc_id").select("doc_id", "quality", "is_test")


@query("stratified_split_by_prefix", (
    f"SELECT o_orderkey, o_orderstatus, is_test FROM {split_sql('orders', 'o_orderstatus', 'o_orderkey')} s"))
def split_prefix(spark, folder):
    """The form for classes too large to order: cut by hash prefix."""
    done = stratified_split(table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", window_rows=100)
    return done.select("o_orderkey", "o_orderstatus", "is_test")


# --- evaluation ---------------------------------------------------------------

# Labelled documents with a score and a prediction that both engines compute alike.
SCORED_SQL = (
    "(SELECT doc_id, quality, n_chars / 20000.0 AS score, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS predicted "
    "FROM labels JOIN documents USING (doc_id))")


def scored(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return joined.select("doc_id", "quality", (F.col("n_chars") / 20000.0).alias("score"),
                         F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"))


@query("confusion", (
    "SELECT CAST(a.c AS BIGINT) AS label, CAST(b.c AS BIGINT) AS prediction, count(quality) AS n FROM (VALUES (0), (1)) "
    f"a(c) CROSS JOIN (VALUES (0), (1)) b(c) LEFT JOIN {SCORED_SQL} s ON quality = a.c AND predicted = b.c "
    "GROUP BY a.c, b.c"
))
def confusion(spark, folder):
    return as_bigint(charts.confusion_matrix(scored(spark, folder), "quality", "predicted", grid=True), ["label", "prediction"])


CLASS_SQL = (
    f"SELECT c, count(*) FILTER (WHERE quality = c) AS actual, count(*) FILTER (WHERE predicted = c) AS guessed, "
    f"count(*) FILTER (WHERE quality = c AND predicted = c) AS hit FROM {SCORED_SQL} s, (VALUES (0), (1)) v(c) GROUP BY c")
ROC_SQL = (
    "SELECT score AS threshold, CAST(sum(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS tp, "
    "CAST(sum(sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END)) OVER w AS BIGINT) AS fp, "
    "sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg "
    f"FROM {SCORED_SQL} s GROUP BY score WINDOW w AS (ORDER BY score DESC)")
AUC_SQL = f"(SELECT sum(neg * (tp - pos / 2.0)) / (max(tp) * max(fp)) FROM ({ROC_SQL}) r)"


@query("class_metrics", (
    "SELECT round(sum(hit) / CAST(sum(actual) AS DOUBLE), 6) AS accuracy, "
    "round(sum(actual * p) / CAST(sum(actual) AS DOUBLE), 6) AS precision, "
    "round(sum(actual * r) / CAST(sum(actual) AS DOUBLE), 6) AS recall, "
    "round(sum(actual * coalesce(2 * p * r / nullif(p + r, 0), 0)) / CAST(sum(actual) AS DOUBLE), 6) AS f1_score, "
    f"round({AUC_SQL}, 6) AS auc FROM (SELECT *, coalesce(hit / CAST(nullif(guessed, 0) AS DOUBLE), 0) AS p, "
    f"coalesce(hit / CAST(nullif(actual, 0) AS DOUBLE), 0) AS r FROM ({CLASS_SQL}) c) k"
))
def class_metrics(spark, folder):
    found = metrics.classification_metrics(scored(spark, folder), "quality", "predicted", "score")
    return rounded(found, found.columns)


@query("roc_points", (
    "SELECT round(threshold, 6) AS threshold, tp, fp, round(tp / CAST(max(tp) OVER () AS DOUBLE), 6) AS tpr, "
    f"round(fp / CAST(max(fp) OVER () AS DOUBLE), 6) AS fpr FROM ({ROC_SQL}) r"
))
def roc_points(spark, folder):
    found = charts.roc_points(scored(spark, folder), "quality", "score")
    return rounded(found.select("threshold", "tp", "fp", "tpr", "fpr"), ["threshold", "tpr", "fpr"])


@query("roc_points_by_range", (
    "SELECT round(threshold, 6) AS threshold, tp, fp FROM (SELECT l_extendedprice AS threshold, "
    "CAST(sum(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS tp, "
    "CAST(sum(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)) OVER w AS BIGINT) AS fp "
    "FROM lineitem GROUP BY l_extendedprice WINDOW w AS (ORDER BY l_extendedprice DESC)) r"
))
def roc_points_by_range(spark, folder):
    """The form for many scores: running counts inside score ranges, offset by the ranges above."""
    found = charts.roc_points(
        LINEITEM.frame(spark, folder), "l_returnflag", "l_extendedprice", positive="R", bucket_rows=2000)
    return rounded(found.select("threshold", "tp", "fp"), ["threshold"])


@query("auc", f"SELECT round({AUC_SQL}, 6) AS auc")
def auc(spark, folder):
    return rounded(charts.area_under_curve(charts.roc_points(scored(spark, folder), "quality", "score")), ["auc"])


@query("cluster_sizes", (
    "SELECT CAST(label AS BIGINT) AS label, concat('Cluster ', label) AS name, count(*) AS n FROM embeddings GROUP BY label"
))
def cluster_sizes(spark, folder):
    return as_bigint(charts.cluster_sizes(table(spark, folder, "embeddings"), "label"), ["label"])


@query("cluster_scatter", (
    "SELECT CAST(s_nationkey AS DOUBLE) AS x, round(s_acctbal, 6) AS y, s_suppkey AS label FROM supplier"
))
def cluster_scatter(spark, folder):
    found = charts.cluster_scatter(SUPPLIER.frame(spark, folder), "s_suppkey", "s_nationkey", "s_acctbal")
    return rounded(found, ["y"])


# --- neighbours and clusters ---------------------------------------------------

VECTORS_SQL = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


@query("knn_predict", (
    f"WITH s AS (SELECT * FROM {split_sql(VECTORS_SQL + ' v', 'label', 'vec_id')} t), near AS (SELECT a.vec_id AS key, "
    "b.label AS label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank "
    "FROM s a, s b WHERE a.is_test AND NOT b.is_test), votes AS (SELECT key, label, count(*) AS n FROM near "
    "WHERE rank <= 5 GROUP BY key, label) SELECT key, CAST(arg_min(label, (1000 - n) * 1000000 + label) AS BIGINT) AS "
    "prediction, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS vote_share FROM votes GROUP BY key"
))
def knn_predict(spark, folder):
    rows = stratified_split(table(spark, folder, "embeddings"), "label", "vec_id")
    found = knn.knn_predict(
        rows.filter(~F.col("is_test")), rows.filter("is_test"), ["embedding"], "vec_id", "label", 5)
    return rounded(as_bigint(found.select("key", "prediction", "vote_share"), ["prediction"]), ["vote_share"])


SCALED_SQL = (
    "(SELECT s_suppkey AS k, (s_nationkey - m1) / d1 AS x, (s_acctbal - m2) / d2 AS y FROM supplier, (SELECT "
    "avg(s_nationkey) AS m1, stddev_pop(s_nationkey) AS d1, avg(s_acctbal) AS m2, stddev_pop(s_acctbal) AS d2 FROM "
    "supplier) p)")


@query("dbscan_labels", (
    f"WITH RECURSIVE pts AS (SELECT * FROM {SCALED_SQL} s), near AS (SELECT a.k AS a, b.k AS b FROM pts a, pts b WHERE "
    "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5), core AS (SELECT a AS k FROM near GROUP BY a "
    "HAVING count(*) >= 5), links AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM "
    "core)), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), "
    "roots AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a), numbered AS (SELECT k, dense_rank() OVER (ORDER BY "
    "root) - 1 AS label FROM roots), borders AS (SELECT n.a AS k, min(c.label) AS label FROM near n JOIN numbered c ON "
    "n.b = c.k WHERE n.a NOT IN (SELECT k FROM core) GROUP BY n.a) SELECT p.k AS key, CAST(coalesce(c.label, b.label, "
    "-1) AS BIGINT) AS label FROM pts p LEFT JOIN numbered c ON p.k = c.k LEFT JOIN borders b ON p.k = b.k"
))
def dbscan_labels(spark, folder):
    scaled, _ = scale(SUPPLIER.frame(spark, folder), "standard", ["s_nationkey", "s_acctbal"])
    return dbscan(scaled, ["s_nationkey", "s_acctbal"], "s_suppkey", 0.5, 5).select("key", "label")


@query("silhouette_exact", (
    f"WITH v AS (SELECT * FROM {VECTORS_SQL} t), d AS (SELECT a.vec_id AS k, a.label AS own, b.label AS c, "
    "sum(list_distance(a.e, b.e)) AS total, count(*) AS n FROM v a, v b GROUP BY a.vec_id, a.label, b.label), "
    "s AS (SELECT k, max(CASE WHEN own = c THEN total / nullif(n - 1, 0) END) AS a, max(CASE WHEN own = c THEN n END) "
    "AS n, min(CASE WHEN own <> c THEN total / n END) AS b FROM d GROUP BY k) SELECT round(avg(CASE WHEN n = 1 THEN 0 "
    "ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM s"
))
def silhouette_exact(spark, folder):
    found = metrics.silhouette_exact(table(spark, folder, "embeddings"), ["embedding"], "label", "vec_id")
    return rounded(found, ["silhouette_score"])


# --- iterative training: no SQL form --------------------------------------------


def document_features(spark, folder):
    def matches(pattern):
        return F.regexp_count("text", F.lit(pattern))

    # Only numbers go to the join, never a text. What can fail is left until after it, to labelled documents.
    counted = table(spark, folder, "documents").select(
        "doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("words"), matches(r"\d").alias("digits"),
        matches(r"[A-Z]").alias("capitals"), matches(r"[^\w\s]").alias("marks"))
    return table(spark, folder, "labels").join(counted, "doc_id").select(
        "doc_id", "quality", F.log1p("n_chars").alias("length"), F.log1p("words").alias("words"),
        *[(F.col(c) / F.col("n_chars")).alias(c) for c in ("digits", "capitals", "marks")])


def _supervised(algorithm):
    def run(spark, folder):
        return train_supervised(document_features(spark, folder), algorithm, "quality", "doc_id").metrics

    return run


for _algorithm, _name in [
    ("logistic_regression", "logistic_regression"), ("random_forest", "random_forest"), ("svm", "svm_rbf"),
    ("knn", "knn_training"),
]:
    query(_name)(_supervised(_algorithm))


@query("logistic_regression_multiclass")
def logistic_regression_multiclass(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return train_supervised(vectors, "logistic_regression", "label", "vec_id", ["embedding"]).metrics


@query("kmeans")
def kmeans(spark, folder):
    vectors = table(spark, folder, "embeddings").drop("label")
    return train_unsupervised(vectors, "kmeans", "vec_id", ["embedding"], {"n_clusters": 10}).metrics


@query("dbscan_training")
def dbscan_training(spark, folder):
    scaled, _ = scale(table(spark, folder, "customer"), "standard", ["c_acctbal", "c_nationkey"])
    return train_unsupervised(
        scaled, "dbscan", "c_custkey", ["c_acctbal", "c_nationkey"], {"eps": 0.15, "min_samples": 5}).metrics


@query("cluster_plot_data")
def cluster_plot_data(spark, folder):
    points, _ = auto_cluster(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")
    return points


# --- facts that a fit must satisfy, whatever its numbers ------------------------


@query("tested_rows", (
    "SELECT algorithm, quality AS label, count(*) AS tested, 0 AS unscored, 0 AS accuracy_gap FROM "
    f"{split_sql('labels', 'quality', 'doc_id')} s, (VALUES ('logistic_regression'), ('random_forest')) a(algorithm) "
    "WHERE is_test GROUP BY algorithm, quality"
))
def tested_rows(spark, folder):
    """Test rows by class, predictions out of range, and the accuracy of the report against that of the predictions."""
    df, parts = document_features(spark, folder), []
    for algorithm in ("logistic_regression", "random_forest"):
        done = train_supervised(df, algorithm, "quality", "doc_id", parameters={"n_estimators": 20})
        right = done.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        gap = int(abs(right - done.metrics.first()["accuracy"]) > 1e-9)
        bad = ~F.col("prediction").isin(0.0, 1.0) | F.col("score").isNull() | ~F.col("score").between(0, 1)
        parts.append(done.predictions.groupBy(F.col("label").cast("bigint").alias("label")).agg(
            F.count(F.lit(1)).alias("tested"), F.count_if(bad).alias("unscored")).select(
            F.lit(algorithm).alias("algorithm"), "label", "tested", "unscored", F.lit(gap).alias("accuracy_gap")))
    return as_bigint(parts[0].unionAll(parts[1]), ["accuracy_gap"])


@query("forest_importances", "SELECT 5 AS features, 0 AS negative, 1.0::DOUBLE AS total")
def forest_importances(spark, folder):
    found = train_supervised(document_features(spark, folder), "random_forest", "quality", "doc_id",
                             parameters={"n_estimators": 20}).importances
    row = (len(found), sum(v < 0 for v in found), round(float(sum(found)), 6))
    return spark.createDataFrame([row], "features int, negative int, total double")


@query("kmeans_facts", (
    "SELECT count(*) AS n_rows, 10 AS n_clusters, 0 AS not_nearest, 0 AS moved_centers FROM embeddings"))
def kmeans_facts(spark, folder):
    """Rows that lie nearer to another centre, and centres that are not the mean of their members."""
    vectors = table(spark, folder, "embeddings")
    done = train_unsupervised(vectors, "kmeans", "vec_id", ["embedding"], {"n_clusters": 10, "silhouette": "squared"})
    centers = spark.createDataFrame(list(enumerate(done.centers)), "label int, center array<double>")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).join(
        done.predictions.select(F.col("key").alias("vec_id"), "label"), "vec_id")
    nearest = F.lit([c for center in done.centers for c in center])
    width = len(done.centers[0])

    def gap(i: int):
        center = F.slice(nearest, i * width + 1, width)
        return F.aggregate(F.zip_with("x", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    gaps = F.array(*[gap(i) for i in range(len(done.centers))])
    judged = rows.withColumn("gaps", gaps).select(
        "label", "x", (F.get("gaps", F.col("label").cast("int")) > F.array_min("gaps") * (1 + 1e-9)).alias("far"))
    means = judged.select("label", F.posexplode("x").alias("place", "value")).groupBy("label", "place").agg(
        F.avg("value").alias("mean"))
    moved = means.join(F.broadcast(centers), "label").filter(
        F.abs(F.col("mean") - F.get("center", F.col("place"))) > 0.01).select("label").distinct().count()
    return judged.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_clusters"),
        F.count_if("far").alias("not_nearest"), F.lit(moved).alias("moved_centers"))
