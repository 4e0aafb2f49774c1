"""Words and word shingles of whole texts as 64-bit hashes, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: tuple[np.ndarray, np.ndarray] = (_powers(_BASE, 2), _powers(_INVERSE, 2))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit of the result depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and UTF-8 bytes of a text column; NULL counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0]:ends[-1]]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of its first word, and the hashes of all words in row order."""
    places, hashes, _, _ = word_spans(texts)
    return places, hashes


def word_spans(texts: pa.Array, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, with the first byte of each word and the byte after it, counted over all rows.

    Words are runs of bytes that ``spaces``, a flag for each byte, does not mark (space
    and 0x09 to 0x0D by default); A-Z count as a-z.
    Texts are worked on in pieces of about ``SEGMENT_BYTES`` cut between words, so
    a very long text needs no more than a few times its own size.
    """
    ends, raw = text_buffers(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(len(ends), np.int64), np.zeros(0, np.uint64), none, none
    space = spaces[raw]
    starts_here = ~space
    starts_here[1:] &= space[:-1]
    firsts = ends[:-1][(ends[:-1] < ends[1:])]
    starts_here[firsts] = ~space[firsts]
    starts = np.flatnonzero(starts_here)
    stops_here = ~space
    stops_here[:-1] &= space[1:]
    lasts = firsts_to_lasts(ends)
    stops_here[lasts] = ~space[lasts]
    stops = np.flatnonzero(stops_here) + 1
    hashes = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(stops, starts[begin] + SEGMENT_BYTES, "right")))
        hashes[begin:end] = _hash_run(raw, starts[begin:end], stops[begin:end])
        begin = end
    return np.searchsorted(starts, ends), hashes, starts, stops


def firsts_to_lasts(ends: np.ndarray) -> np.ndarray:
    return ends[1:][ends[:-1] < ends[1:]] - 1


def _hash_run(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    global _POWERS
    low, high = int(starts[0]), int(stops[-1])
    if len(_POWERS[0]) < high - low:
        size = max(high - low, SEGMENT_BYTES)
        _POWERS = (_powers(_BASE, size), _powers(_INVERSE, size))
    values = _LOWER[raw[low:high]].astype(np.uint64)
    values += np.uint64(1)
    values *= _POWERS[0][:high - low]
    sums = np.zeros(high - low + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    s = starts - low
    return mix((sums[stops - low] - sums[s]) * _POWERS[1][s])


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    if len(values) < 2:
        return values
    ordered = np.sort(values)
    first = np.empty(len(ordered), bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter sequence counts as one run as a whole."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix(_combine([words[i:i + 1] for i in range(n)]) + np.uint64(n))
    return mix(_combine([words[i:n - size + 1 + i] for i in range(size)]) + np.uint64(size))


def shingles_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hashes of :func:`shingle_hashes` at some places only."""
    return mix(_combine([words[at + i] for i in range(size)]) + np.uint64(size))


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        total = total * np.uint64(_BASE) + part
        total ^= total >> np.uint64(29)
    return total


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES
                  ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text, or one row; free memory is given back after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, _ = text_buffers(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop
    # Workers wait for their next task beside the other processes of an executor; what they no longer need goes back.
    pa.default_memory_pool().release_unused()


def _changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """The rows whose keys differ from those of the row before."""
    changes = np.zeros(batch.num_rows - 1, dtype=bool)
    for k in keys:
        c = batch.column(k).to_numpy(zero_copy_only=False)
        changes |= c[1:] != c[:-1]
    return (np.flatnonzero(changes) + 1).tolist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole groups of consecutive rows with equal keys, and the rows where groups begin, with the end."""
    held: list[pa.RecordBatch] = []

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[int]]:
        batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return batch, [0, *_changes(batch, keys), batch.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield joined(held)
            held = []
        cuts = _changes(batch, keys)
        if cuts:
            yield joined([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys as one table, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
