"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a short vector of transformed statistics. For each class the
mean and covariance follow from sums that Spark adds up over the labelled rows;
the covariance is shrunk towards a scaled identity by the oracle approximating
rule (Chen, Wiesel, Eldar and Hero, 2010) and towards the pooled covariance. A
score is the logistic function of the difference of the two Gaussian
log-densities, from Mahalanobis distances with Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, sized, table
from veritab.llm.words import distinct, small_batches, text_buffers, word_spans

THRESHOLD = 0.3
POOLED_SHARE = 0.1
TEMPERATURE = 4.0
N_FEATURES = 16

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MULTI = np.arange(256) >= 128
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[44, 46, 58, 59]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _SENTENCE)
_MARK = np.zeros(256, bool)
_MARK[[33, 63]] = True
_PIPE = np.zeros(256, bool)
_PIPE[124] = True
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _MULTI, _SENTENCE, _SYMBOL, _MARK, _PIPE]).astype(np.float64)


# Shares of a typical text, which short texts are drawn towards.
_TYPICAL = np.array([0.03, 0.86, 0.003, 0.05, 0.045, 0.002, 0.001, 0.001])
_BYTES, _WORDS = 40.0, 8.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` finite numbers for each whole text; NULL counts as an empty text.

    Every share is drawn towards a typical value by ``_BYTES`` bytes or ``_WORDS``
    words, so that a short text is not judged by a few characters.
    """
    ends, raw = text_buffers(texts)
    places, hashes, starts, stops = word_spans(texts)
    counts = np.zeros((len(texts), 256))
    for i in range(len(texts)):
        counts[i] = np.bincount(raw[ends[i]:ends[i + 1]], minlength=256)
    size = counts.sum(axis=1)
    spaces = counts[:, 9:14].sum(axis=1) + counts[:, 32]
    shares = (counts @ _CLASSES.T + _BYTES * _TYPICAL) / (size - spaces + _BYTES)[:, None]
    n = np.diff(places).astype(np.float64)
    most, own, pairs = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
        if b > a:
            words = np.sort(hashes[a:b])
            cuts = np.flatnonzero(words[1:] != words[:-1])
            own[i] = len(cuts) + 1
            most[i] = np.diff(cuts, prepend=-1, append=len(words) - 1).max()
            pairs[i] = len(distinct(hashes[a:b - 1] * np.uint64(31) + hashes[a + 1:b])) + 1
    length = (stops - starts).astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), np.diff(places))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=len(texts))

    mean = (total(length) + _WORDS * 5.5) / (n + _WORDS)
    spread = (total((length - mean[owner]) ** 2) + _WORDS * 8.0) / (n + _WORDS)
    first_upper = (total(_UPPER[raw[starts]]) + _WORDS * 0.1) / (n + _WORDS)
    short = (total(length <= 2) + _WORDS * 0.2) / (n + _WORDS)
    return np.column_stack([
        np.log1p(n), np.log1p((size + _BYTES) / (counts[:, 10] + 1)),
        *[np.log(0.002 + shares[:, k]) for k in (0, 2, 3, 4, 5, 6, 7)],
        np.log((own + _WORDS) / (n + _WORDS)), np.log((pairs + _WORDS) / (n + _WORDS)),
        np.log(0.001 + (most + _WORDS * 0.06) / (n + _WORDS)),
        np.log(mean), 0.5 * np.log(spread), np.log(0.002 + first_upper), np.log(0.002 + short),
    ])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        x = statistics(batch.column("text"))
        yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "h1", "h2")},
                               "x": pa.FixedSizeListArray.from_arrays(x.ravel(), N_FEATURES).cast(
                                   pa.list_(pa.float64()))})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the count, sums and sums of products of the vectors of one task."""
    totals = np.zeros((2, 1 + N_FEATURES, 1 + N_FEATURES))
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                totals[c] += x[y == c].T @ x[y == c]
    c, i, j = (k.ravel() for k in np.indices(totals.shape))
    yield pa.record_batch({"c": pa.array(c.astype(np.int32)), "i": pa.array(i.astype(np.int32)),
                           "j": pa.array(j.astype(np.int32)), "total": pa.array(totals.ravel())})


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the covariances, and the constants of the log-densities."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        log_density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse_factors[c].T
            log_density.append(self.constants[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        margin = np.clip((log_density[1] - log_density[0]) / self.temperature, -500, 500)
        return 1.0 / (1.0 + np.exp(-margin))


def shrunk(covariance: np.ndarray, n: float) -> np.ndarray:
    """Covariance shrunk towards a scaled identity by the oracle approximating rule."""
    p = len(covariance)
    trace, square = np.trace(covariance), np.trace(covariance @ covariance)
    wanted = (1 - 2 / p) * square + trace ** 2
    most = (n + 1 - 2 / p) * (square - trace ** 2 / p)
    share = 1.0 if most <= 0 else min(1.0, wanted / most)
    return (1 - share) * covariance + share * trace / p * np.eye(p)


def fit(totals: np.ndarray, pooled_share: float = POOLED_SHARE) -> Discriminant:
    """The discriminant for the two classes' sums; a class without rows gets the pooled shape and weight 1."""
    n = totals[:, 0, 0]
    pooled_n = max(1.0, n.sum())
    means, scatters = [], []
    for c in (0, 1):
        mean = totals[c, 0, 1:] / max(1.0, n[c]) if n[c] else totals[:, 0, 1:].sum(axis=0) / pooled_n
        means.append(mean)
        scatters.append(totals[c, 1:, 1:] - n[c] * np.outer(mean, mean))
    pooled = sum(scatters) / pooled_n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    inverse, constants = [], []
    for c in (0, 1):
        own = scatters[c] / n[c] if n[c] > N_FEATURES else pooled
        mixed = ((1 - pooled_share) * own + pooled_share * pooled) / np.outer(scale, scale)
        factor = np.linalg.cholesky(shrunk(mixed, max(n[c], 2.0)) + 1e-6 * np.eye(N_FEATURES))
        inverse.append(np.linalg.inv(factor) / scale)
        constants.append(np.log((n[c] + 1) / (pooled_n + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(inverse), np.array(constants))


def _score(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES)
        yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "h1", "h2")},
                               "score": pa.array(model.scores(x))})


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; ``score`` is 0 to 1, higher: label 1 likelier.

    All labelled rows whose ``crc32(doc_id as text) mod 5`` is not 0 are learnt
    from; there is no sample. Only the text enters a score. NULL texts count as
    empty and get a score too. Labels other than 0 and 1, and rows without an id,
    are not learnt from; of several labels of one id the smallest counts; rows
    that share an id are each learnt from and scored. Without labelled rows every
    text scores the same. Other columns are ignored; an empty table gives no rows.
    """
    return _scored(documents, labels, threshold).select("doc_id", "held_out", "score", "predicted")


def _hashes(text: Column) -> tuple[Column, Column]:
    """96 bits that stand for a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole).alias("h1"), F.hash(whole).alias("h2")


def _scored(documents: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), *_hashes(documents["text"]),
                            documents["text"].cast("string").alias("text"))
    features = scratch.write(rows.mapInArrow(_features, "doc_id long, h1 long, h2 int, x array<double>"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    known = known.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    learnt = features.join(known.filter(~held_out()), "doc_id").select("x", "label")
    totals = np.zeros((2, 1 + N_FEATURES, 1 + N_FEATURES))
    summed = learnt.mapInArrow(_sums, "c int, i int, j int, total double").groupBy("c", "i", "j").agg(
        F.sum("total").alias("total"))
    for c, i, j, total in summed.collect():  # always 2 * 17 * 17 rows
        totals[c, i, j] = total
    model = fit(totals)
    scored = features.mapInArrow(partial(_score, model=model), "doc_id long, h1 long, h2 int, score double")
    return scored.select("doc_id", "h1", "h2", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``threshold``, with all their columns.

    The score depends on the text alone, so rows with equal texts stay or go together.
    """
    scratch = Scratch(documents.sparkSession)
    rejected = scratch.write(_scored(documents, labels, threshold).filter("predicted = 0").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct())
    h1, h2 = _hashes(documents["text"])
    return documents.join(sized(rejected, rejected.count()), (h1 == F.col("_h1")) & (h2 == F.col("_h2")), "left_anti")


@query("op2_quality_scores")
def _quality_scores(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
