"""Co-moments of all pairs of columns from one pass over a table.

A task keeps, for every pair of columns, the moments over the rows where both
are present: their number, both means, both sums of squared deviations and the
sum of products of deviations, as matrices filled by a few matrix products for
each batch. Two such states merge exactly (Chan, Golub and LeVeque, 1979), so
the states of the tasks are merged in two small aggregates, band by band of
their rows. The table is scanned once, however many columns and NULLs it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.schema import as_double

BAND_CELLS = 1 << 16
MERGE_TASKS = 64
# A sum of squares this much smaller than what it was taken from is rounding, not deviation.
ROUNDING = 1e-12
_STATE = "band int, task int, moments binary"

# Eight matrices (or a band of rows of each): rows that hold both values, mean of the row's and of the column's column
# over them, sum of products of deviations, squared deviations of the row's and of the column's column, and what these
# two were taken from: squared distances from a value near each batch's mean.
State = np.ndarray
MATRICES = 8


def batch_state(values: np.ndarray, present: np.ndarray) -> State:
    """The moments of one batch; ``values`` is 0 where not ``present``."""
    width = values.shape[1]
    counts = present.sum(axis=0)
    shift = np.divide(values.sum(axis=0), counts, out=np.zeros(width), where=counts > 0)
    low = np.min(values, axis=0, initial=np.inf, where=present)
    high = np.max(values, axis=0, initial=-np.inf, where=present)
    shift = np.where(low == high, low, shift)
    moved = np.where(present, values - shift, 0.0)
    if present.all():
        n = np.full((width, width), float(len(values)))
        sums = np.repeat(moved.sum(axis=0)[:, None], width, axis=1)
        squares = np.repeat((moved ** 2).sum(axis=0)[:, None], width, axis=1)
    else:
        flags = present.astype(np.float64)
        n, sums, squares = flags.T @ flags, moved.T @ flags, (moved ** 2).T @ flags
    mean = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
    deviation = np.maximum(squares - sums * mean, 0.0)
    products = moved.T @ moved - sums * mean.T
    mean = mean + shift[:, None]
    return np.stack([n, mean, mean.T, products, deviation, deviation.T, squares, squares.T])


def merged(one: State, other: State) -> State:
    """The moments of two disjoint sets of rows together."""
    n = one[0] + other[0]
    share = np.divide(other[0], n, out=np.zeros_like(n), where=n > 0)
    weight = one[0] * share
    both = (one[0] > 0) & (other[0] > 0)
    up, across = (np.where(both, other[k] - one[k], 0.0) for k in (1, 2))
    mean, mean_across = (
        np.where(one[0] > 0, one[k] + d * share, other[k]) for k, d in ((1, up), (2, across)))
    return np.stack([n, mean, mean_across, one[3] + other[3] + up * across * weight,
                     one[4] + other[4] + up ** 2 * weight, one[5] + other[5] + across ** 2 * weight,
                     one[6] + other[6], one[7] + other[7]])


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, n, co, dev_i, dev_j`` for every pair of positions in ``columns``, from one scan.

    ``n`` rows hold both values; ``co`` sums the products of their deviations and
    ``dev_*`` the squared ones. Deviations that are rounding alone are exactly 0. A
    table without rows gives all pairs with ``n`` = 0; infinite values make the
    moments of their columns NaN.
    """
    width = len(columns)
    rows = max(1, BAND_CELLS // max(1, width))
    bands = -(-width // rows)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                present = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1)
                values = np.stack([c.fill_null(0.0).to_numpy() for c in batch.columns], axis=1)
                found = batch_state(values, present)
                state = found if state is None else merged(state, found)
        if state is not None:
            task = TaskContext.get().partitionId()
            for band in range(bands):
                part = np.ascontiguousarray(state[:, band * rows:(band + 1) * rows])
                yield pa.record_batch({
                    "band": pa.array([band], pa.int32()), "task": pa.array([task], pa.int32()),
                    "moments": pa.array([part.tobytes()], pa.binary())})

    def states(group: pa.Table) -> State:
        return reduce(merged, (np.frombuffer(x).reshape(MATRICES, -1, width) for x in group["moments"].to_pylist()))

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({
            "band": group["band"].slice(0, 1), "task": pa.array([0], pa.int32()),
            "moments": pa.array([states(group).tobytes()], pa.binary())})

    def pairs(group: pa.Table) -> pa.Table:
        n, _, _, co, own, other, *squares = states(group)
        own, other = (np.where(d <= ROUNDING * s, 0.0, d) for d, s in zip((own, other), squares))
        first = group["band"][0].as_py() * rows
        i, j = np.meshgrid(np.arange(first, first + len(n)), np.arange(width), indexing="ij")
        return pa.table({
            "i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()),
            "n": pa.array(n.ravel().astype(np.int64)), "co": pa.array(co.ravel()),
            "dev_i": pa.array(own.ravel()), "dev_j": pa.array(other.ravel())})

    nothing = np.zeros((MATRICES, width, width))
    none = df.sparkSession.createDataFrame(
        [(b, -1, bytearray(nothing[:, b * rows:(b + 1) * rows].tobytes())) for b in range(bands)], _STATE)
    found = df.select(*[as_double(c).alias(str(i)) for i, c in enumerate(columns)]).mapInArrow(partial, _STATE)
    regions = found.groupBy("band", F.floor(F.col("task") / MERGE_TASKS).alias("region")).applyInArrow(merge, _STATE)
    moments = regions.unionAll(none).groupBy("band").applyInArrow(
        pairs, "i int, j int, n long, co double, dev_i double, dev_j double")
    return moments.select("i", "j", "n", "co", "dev_i", "dev_j")
