"""Feature vectors and exact Euclidean distances inside tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.schema import as_double, col, numeric_only, require_columns

LOST_DIGITS = 1e-7
TASK_ROWS = 10_000
TASK_VALUES = 1 << 22


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    """``array<double>`` from numeric columns, or from one array column.

    A missing feature is an error: distances and models need complete rows.
    """
    require_columns(df, features)
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        array = col(features[0]).cast("array<double>")
    else:
        text = [f for f in features if f not in numeric_only(df, features)]
        if text:
            raise ValueError(f"features must be numeric: {text}")
        array = F.array(*[as_double(f) for f in features])
    broken = array.isNull() | F.exists(array, lambda v: v.isNull() | F.isnan(v))
    return F.when(broken, F.raise_error(F.lit("a feature is missing; fill or drop it first"))).otherwise(array)


def feature_vector(df: DataFrame, features: Sequence[str]) -> Column:
    return array_to_vector(feature_array(df, features))


def spread(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` dealt evenly for training that reads it again and again, ``width`` numbers to a row.

    A small file of few columns is read by one task, and its rows may grow there. No task gets more
    than ``TASK_VALUES`` numbers, and every core has rows if there are ``TASK_ROWS`` for each; a
    table of fewer rows stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(rows * width / TASK_VALUES), min(cores, rows // TASK_ROWS))
    return df.repartition(parts) if parts > 1 else df


def matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def distances_to(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1))


def distance_sums(ones: np.ndarray, points: np.ndarray, rows: int = 64, columns: int = 2048) -> np.ndarray:
    """Sum of the distances of each of ``ones`` to all ``points``, by matrix products over tiles that fit a cache.

    Both sides are shifted to the mean of the points. A squared distance that is small
    against the lengths it comes from has lost digits and is taken again by difference.
    """
    shift = points.mean(axis=0)
    a, b = ones - shift, points - shift
    own, lengths = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    turned = np.ascontiguousarray(b.T) * -2.0
    totals = np.zeros(len(a))
    for low in range(0, len(b), columns):
        right = slice(low, low + columns)
        longest = lengths[right].max()
        for top in range(0, len(a), rows):
            left = slice(top, top + rows)
            squares = a[left] @ turned[:, right]
            squares += lengths[right]
            squares += own[left, None]
            if squares.min() < LOST_DIGITS * (own[left].max() + longest):
                lost = squares < LOST_DIGITS * (own[left, None] + lengths[right])
                for i in np.flatnonzero(lost.any(axis=1)):
                    squares[i, lost[i]] = ((a[top + i] - b[right][lost[i]]) ** 2).sum(axis=1)
            totals[left] += np.sqrt(squares, out=squares).sum(axis=1)
    return totals
