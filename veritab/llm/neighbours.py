"""Nearest neighbours by inner product: collision counting over sorted projections with virtual rehashing.

Vectors get one more component that makes all norms equal, so the largest inner
product is the smallest distance. Each block of rows keeps its rows sorted along
each of ``PROJECTIONS`` orthogonal directions (Huang et al., query-aware hashing,
2015). For a query, windows centred at its own projections are as wide as a
radius allows; a row that collides in more directions than a row at that radius
almost always would is verified. The radius starts below the distance of the
wanted number of rows near the query along one direction, and grows, with the
windows, to the distance of the wanted number of verified rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.llm.base import query, table

BLOCK_ROWS = 16384
QUERY_ROWS = 4096
HALF_WIDTH = 1.2
DEVIATIONS = 1.0
FIRST_ROWS = 256
FIRST_SHARE = 0.75
GROWTH = 1.25
SEED = 20


def directions(size: int) -> np.ndarray:
    """Orthogonal directions, one column each, of length 1 on an average component."""
    basis, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return basis * math.sqrt(size)


class Block:
    """Rows sorted along every direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.vectors, self.norm = ids, vectors, norm
        rest = np.sqrt(np.maximum(0.0, norm ** 2 - (vectors ** 2).sum(axis=1)))
        self.axes = directions(vectors.shape[1] + 1)
        projected = np.column_stack([vectors, rest]) @ self.axes
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(projected, axis=0).T)
        m = self.axes.shape[1]
        share = math.erf(HALF_WIDTH / math.sqrt(2))
        self.least = max(1, math.floor(m * share - DEVIATIONS * math.sqrt(m * share * (1 - share))))

    def search(self, own: int, vector: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The ``k`` best rows other than those of id ``own``: ``(id, inner product)``, best first."""
        n = len(self.ids)
        at = np.append(vector, 0.0) @ self.axes
        farthest = float(vector @ vector) + self.norm ** 2
        counts = np.zeros(n, np.int16)
        known = self.ids == own
        low = [int(np.searchsorted(s, a)) for s, a in zip(self.sorted, at)]
        high = list(low)
        near = self.order[0, max(0, low[0] - FIRST_ROWS):low[0] + FIRST_ROWS]
        fresh = near[~known[near]]
        rows, products = [], []
        radius = 0.0
        while True:
            known[fresh] = True
            rows.append(fresh)
            products.append(self.vectors[fresh] @ vector)
            got = np.concatenate(products)
            everything = len(got) == n or bool(known.all())
            # The k-th best row so far bounds how far the windows must reach.
            bound = math.sqrt(max(0.0, farthest - 2 * np.partition(got, len(got) - k)[len(got) - k])) if len(
                got) >= k else math.inf
            if everything or radius >= bound:
                break
            step = max(radius * GROWTH, FIRST_SHARE * min(bound, 2 * math.sqrt(farthest)), 1e-9)
            radius = bound if radius else min(step, bound)
            if math.isinf(radius):
                radius = step
            half = HALF_WIDTH * radius
            for j, a in enumerate(at.tolist()):
                line, order = self.sorted[j], self.order[j]
                l, h = min(int(line.searchsorted(a - half)), low[j]), max(int(line.searchsorted(a + half)), high[j])
                counts[order[l:low[j]]] += 1
                counts[order[high[j]:h]] += 1
                low[j], high[j] = l, h
            whole = all(x == 0 for x in low) and all(x == n for x in high)
            fresh = np.flatnonzero(~known & ((counts >= self.least) | whole))
        rows_found = np.concatenate(rows)
        if len(got) > k:
            near = got >= np.partition(got, len(got) - k)[len(got) - k] - 1e-6 * (1 + farthest)
            rows_found = rows_found[near]
        exact = np.zeros(len(rows_found))
        for d in range(len(vector)):  # one order of additions, so that equal vectors score the same
            exact += self.vectors[rows_found, d] * vector[d]
        best = np.lexsort((self.ids[rows_found], -exact))[:k]
        return [(int(self.ids[rows_found[i]]), float(exact[i])) for i in best]


def _search(group: pa.Table, k: int) -> pa.Table:
    asked = np.array(group["asked"].to_pylist(), dtype=bool)
    ids = group["vec_id"].to_numpy()
    size = group["dim"][0].as_py()
    vectors = np.asarray(group["v"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, size)
    out: list[tuple[int, int, float]] = []
    if (~asked).any():
        block = Block(ids[~asked], np.ascontiguousarray(vectors[~asked]), group["norm"][0].as_py())
        for own, vector in zip(ids[asked].tolist(), vectors[asked]):
            out += [(own, i, score) for i, score in block.search(own, vector, k)]
    q, i, s = zip(*out) if out else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()),
                     "score": pa.array(s, pa.float64())})


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query.

    Queries are the rows whose vec_id is divisible by ``every``; all rows but those
    of the query's own id are searched. Scores are exact, in double precision; ties
    go to the smaller vec_id. Rows without an id and vectors that are NULL, empty,
    zero or hold NULL or non-finite components take no part; vectors meet those of
    the same length only. A repeated query row is one query, taken with its
    smallest vector. Other columns are ignored; an empty table gives no rows.
    """
    v = embeddings["embedding"].cast("array<double>")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    is_query = F.col("vec_id") % every == 0
    n, n_queries, norm = rows.agg(
        F.count(F.lit(1)), F.count_if(is_query),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    blocks, parts = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n_queries / QUERY_ROWS))
    norm = (norm or 0.0) * (1 + 1e-12)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, asked: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_own)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).select(
            "dim", F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"), "vec_id", "v",
            F.lit(asked).alias("asked"), F.lit(norm).alias("norm"))

    queries = rows.filter(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    both = dealt(rows, "block", blocks, "part", parts, False).unionByName(
        dealt(queries, "part", parts, "block", blocks, True))
    found = both.groupBy("dim", "block", "part").applyInArrow(
        lambda group: _search(group, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


@query("op10_nearest")
def _nearest(spark, folder):
    return nearest(table(spark, folder, "embeddings"))
