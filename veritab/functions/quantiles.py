"""Exact linear-interpolated quantiles of all columns at once, by radix selection.

A double becomes a 64-bit key in the same order. One pass counts the values of
every column by the first bits of their keys; a rank lies in one of these
prefixes, and the next pass counts by more bits, but only below prefixes that
hold a wanted rank. A prefix whose values are all equal is settled, and one that
holds few values is settled by counting its keys. Tasks send counts, so a pass
shuffles at most its prefixes, and the driver gets one row for each wanted rank.
No buffer holds a column, whatever its size or its skew: equal values are one key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.schema import as_double

# Values below one prefix that are few enough to count their keys instead of further prefixes.
BUFFER_ROWS = 2_000
FIRST_BITS = 16
MORE_BITS = 10
_SIGN = np.uint64(1 << 63)
_COUNTS = "position int, open int, prefix long, held long, low long, high long"


@dataclass(frozen=True)
class _Open:
    """Values of a column that share the first ``bits`` bits of their keys, and the ranks wanted among them."""

    position: int
    prefix: int
    bits: int
    held: int
    ranks: tuple[tuple[int, int], ...]  # rank among these values, rank in the column

    def next_bits(self, buffer_rows: int) -> int:
        return 64 if self.held <= buffer_rows else min(64, self.bits + MORE_BITS)


def keys_of(values: np.ndarray) -> np.ndarray:
    """64-bit keys that order like the values; both zeros have one key."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)[0])


def _signed(keys: np.ndarray) -> np.ndarray:
    """Unsigned keys as signed ones in the same order, as Spark's long is signed."""
    return (keys ^ _SIGN).view(np.int64)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per column with linear interpolation; ``None`` for a column without values.

    Up to seven passes, whatever the number of columns: 16 bits, then 10 more in
    each, until every open prefix holds ``buffer_rows`` values or one.
    """
    columns = list(columns)
    if not columns:
        return {}
    numbers = df.select(*[as_double(c).alias(str(i)) for i, c in enumerate(columns)])
    found: dict[tuple[int, int], float] = {}
    sizes: dict[int, int] = {}
    opened = [_Open(i, 0, 0, 0, ()) for i in range(len(columns))]
    while opened:
        rows = _selected(numbers, opened, probabilities, buffer_rows)
        following: dict[tuple[int, int, int], tuple[int, list[tuple[int, int]]]] = {}
        for position, prefix, bits, held, inside, rank, size, low, high in rows:
            sizes.setdefault(position, size)
            if low == high:
                found[position, rank] = value_of(low + (1 << 63))
            else:
                following.setdefault((position, prefix, bits), (held, []))[1].append((inside, rank))
        opened = [_Open(*place, held, tuple(ranks)) for place, (held, ranks) in sorted(following.items())]
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        result[c] = []
        for p in probabilities:
            if not sizes.get(i):
                result[c].append(None)
                continue
            at = p * (sizes[i] - 1)
            below, above = found[i, math.floor(at)], found[i, math.ceil(at)]
            result[c].append(below if below == above else below + (above - below) * (at - math.floor(at)))
    return result


def _selected(numbers: DataFrame, opened: list[_Open], probabilities: Sequence[float], buffer_rows: int) -> list:
    """One pass: the longer prefix each wanted rank lies in.

    Rows of position, prefix, its bits, the values it holds, the rank among them,
    the rank in the column, the column's values, and the smallest and largest key.
    """
    first = opened[0].bits == 0
    bits = {k: FIRST_BITS if first else o.next_bits(buffer_rows) for k, o in enumerate(opened)}
    by_column: dict[int, list[int]] = {}
    for k, o in enumerate(opened):
        by_column.setdefault(o.position, []).append(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for position, places in by_column.items():
                column = batch.column(position)
                keys = keys_of((column.drop_null() if column.null_count else column).to_numpy())
                for k in places:
                    o = opened[k]
                    mine = keys if first else keys[keys >> np.uint64(64 - o.bits) == np.uint64(o.prefix)]
                    if len(mine):
                        held[k] = _counted(held.get(k), mine, bits[k])
        if held:
            prefixes, counts, low, high = (np.concatenate([h[i] for h in held.values()]) for i in range(4))
            lengths = [len(h[0]) for h in held.values()]
            yield pa.record_batch({
                "position": pa.array(np.repeat([opened[k].position for k in held], lengths), pa.int32()),
                "open": pa.array(np.repeat(list(held), lengths), pa.int32()),
                "prefix": pa.array(prefixes.view(np.int64)), "held": pa.array(counts.view(np.int64)),
                "low": pa.array(_signed(low)), "high": pa.array(_signed(high))})

    def select(group: pa.Table) -> pa.Table:
        position = group["position"][0].as_py()
        order = np.lexsort((group["prefix"].to_numpy().view(np.uint64), group["open"].to_numpy()))
        places, prefix, held, low, high = (
            group[c].to_numpy()[order] for c in ("open", "prefix", "held", "low", "high"))
        out = []
        for k in np.unique(places).tolist():
            here = np.flatnonzero(places == k)
            upto = np.cumsum(held[here])
            size = int(upto[-1])
            ranks = opened[k].ranks if not first else sorted({(r, r) for p in probabilities for r in (
                math.floor(p * (size - 1)), math.ceil(p * (size - 1)))})
            for inside, rank in ranks:
                at = int(np.searchsorted(upto, inside, "right"))
                i = here[at]
                out.append((position, int(prefix[i]), bits[k], int(held[i]), inside - int(upto[at]) + int(held[i]), rank,
                            size if first else -1, int(low[i]), int(high[i])))
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in zip(*out)))))

    names = ["position", "prefix", "bits", "held", "inside", "rank", "size", "low", "high"]
    counted = numbers.mapInArrow(count, _COUNTS).groupBy("position", "open", "prefix").agg(
        F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = counted.groupBy("position").applyInArrow(select, ", ".join(f"{n} long" for n in names)).collect()
    return [tuple(r[n] for n in names) for r in rows]


def _counted(held: list[np.ndarray] | None, keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Prefixes, counts, and smallest and largest keys, with those of more keys added."""
    prefixes = keys >> np.uint64(64 - bits)
    order = np.argsort(prefixes, kind="stable")
    prefixes, keys = prefixes[order], keys[order]
    starts = np.flatnonzero(np.append(True, prefixes[1:] != prefixes[:-1]))
    counts = np.diff(np.append(starts, len(keys))).astype(np.uint64)
    new = [prefixes[starts], counts, np.minimum.reduceat(keys, starts), np.maximum.reduceat(keys, starts)]
    if held is None:
        return new
    both = [np.concatenate(x) for x in zip(held, new)]
    order = np.argsort(both[0], kind="stable")
    both = [x[order] for x in both]
    starts = np.flatnonzero(np.append(True, both[0][1:] != both[0][:-1]))
    return [both[0][starts], *[f.reduceat(x, starts) for f, x in zip((np.add, np.minimum, np.maximum), both[1:])]]
