"""Passages that repeat across documents: shared seeds, collinear chains, alignment.

Runs of ``SEED`` words are thinned by winnowing, so that any ``SEED + WINDOW - 1``
equal words share a seed. Places of a seed at equal distances in one text are one
row, so periodic text has few. Each occurrence of a seed is matched with the first
one only (smallest doc_id, then place), so a passage shared by many documents
gives one match per occurrence, never all pairs. The matches of two documents are
chained in order in both (Abouelhoda and Ohlebusch, 2005): a Fenwick tree over
the places in the first document holds the best chain that ends there, and a
gap costs its length. Chains are then aligned word by word, and stretches of at
least ``least`` words of which ``percent`` agree are passages.

The seeds of one passage may have their first occurrences in different places,
or in line in a document that differs between them. So a run of ``least`` words
whose seeds all repeat is hashed as a whole and matched with the first occurrence
of that run (with one at the same distance from it as its neighbours, if the first document repeats the run at equal
distances), unless the first occurrences of its seeds are in line in one document
and stand there among the same words, so that this document holds the run. Then
the matches with it do, and neighbouring matches in line stay in one chain. Matched
runs that no aligned passage covers make equal stretches; they join the seeds of
their documents in further chains, and those still uncovered are passages themselves.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, table
from veritab.llm.words import distinct, grouped, mix, shingle_hashes, shingles_at, small_batches, text_buffers, whole_groups
from veritab.llm.words import word_hashes, word_spans

SEED = 6
WINDOW = 12
GAP_COST = 0.05
BLOCK = 64
MARGIN = 64
MAX_GAP_CELLS = 1 << 20
BATCH_BYTES = 2 << 20


def window_minima(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Place of the smallest value, the first of equal ones, in every window of ``window`` values."""
    low, at, size = grams, np.arange(len(grams)), 1
    while size < window:
        step = min(size, window - size)
        if len(low) <= step:
            return at[:0]
        at = np.where(low[step:] < low[:-step], at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        size += step
    return at


def winnowed(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value in every window of ``window`` values."""
    if len(grams) <= window:
        return np.array([int(grams.argmin())] if len(grams) else [], dtype=np.int64)
    return distinct(window_minima(grams, window))


def _contexts(words: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Hashes of the words up to a window's length around seeds; where the text ends before, they equal no other's.

    For each seed ``first`` and ``end`` bound its text in ``words``; ``at`` is its place in the text.
    """
    around = WINDOW - 1
    place = first + at
    inside = (at >= around) & (place + SEED + around <= end)
    found = mix(doc_id.astype(np.int64).view(np.uint64) + at.astype(np.uint64))
    found[inside] = shingles_at(words, place[inside] - around, SEED + 2 * around)
    return found.view(np.int64).astype(np.int32)


def _batch_windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``SEED`` words of all texts of a batch, also across texts, and the minima of their windows."""
    grams = shingle_hashes(hashes, SEED) if len(hashes) >= SEED else hashes[:0]
    return grams, window_minima(grams)


def _seeds(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Series of places of the seeds of texts of ``least`` words or more, with the context of the first place."""
    for batch in small_batches(batches, size=BATCH_BYTES):
        places, hashes = word_hashes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        seeds, where, rows = [], [], []
        batch_grams, minima = _batch_windows(hashes)
        for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
            if b - a < least:
                continue
            if b - a < SEED + WINDOW:
                grams = shingle_hashes(hashes[a:b], SEED)
                at = winnowed(grams)
            else:
                grams, at = batch_grams[a:b - SEED + 1], minima[a:b - SEED - WINDOW + 2] - a
                at = at[np.append(True, at[1:] != at[:-1])]
            seeds.append(grams[at])
            where.append(at)
            rows.append(np.full(len(at), i))
        if seeds:
            at, row, seed = np.concatenate(where), np.concatenate(rows), np.concatenate(seeds).view(np.int64)
            order, first, step, times = _series(row, seed, at)
            row, seed, at = row[order][first], seed[order][first], at[order][first]
            yield pa.record_batch({"seed": seed, "doc_id": ids[row], "place": at.astype(np.int32),
                                   "step": step.astype(np.int32), "times": times.astype(np.int32),
                                   "context": _contexts(hashes, places[row], places[row + 1], at, ids[row])})


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the runs of ``least`` words whose seeds all repeat, and do not show that one document holds the run."""
    inner = max(0, least - SEED - WINDOW + 2)  # windows of seeds inside one run
    for batch in small_batches(batches, size=BATCH_BYTES):
        places, hashes = word_hashes(batch.column("text"))
        ids, repeated = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("repeated")
        rows, where = [], []
        held, names = repeated.flatten(), ["source", "source_place", "source_context"]
        place, step, times, *others = (
            held.field(f).to_numpy(zero_copy_only=False) for f in ["place", "step", "times", *names])
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(repeated).to_numpy(zero_copy_only=False))
        place, row, *others = _every_place(place, step, times, row, *others)
        fields = {"place": place, **dict(zip(names, others))}
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(ids))))
        fields["alike"] = fields["source_context"] == _contexts(
            hashes, places[row], places[row + 1], fields["place"], ids[row])
        batch_grams, minima = _batch_windows(hashes)
        for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
            if b - a < least:
                continue
            grams = batch_grams[a:b - SEED + 1] if b - a >= SEED else shingle_hashes(hashes[a:b], SEED)
            place, source, source_place, own = (
                fields[f][ends[i]:ends[i + 1]] for f in ("place", "source", "source_place", "alike"))
            first_in, line = np.full(len(grams), -1, np.int64), np.zeros(len(grams), np.int64)
            single, alike = np.ones(len(grams), dtype=bool), np.zeros(len(grams), dtype=bool)
            first_in[place], line[place], single[place] = source, source_place.astype(np.int64) - place, False
            alike[place] = own
            at = np.arange(b - a - least + 1)
            if inner:
                seed = minima[a:b - SEED - WINDOW + 2] - a
                count = np.zeros(len(seed) + 1, np.int64)
                np.cumsum(single[seed], out=count[1:])
                wanted = count[inner:inner + len(at)] == count[:len(at)]
                if inner > WINDOW:  # only then a run holds two seeds, which make a chain
                    turns, other = np.zeros(len(seed) + 1, np.int64), np.zeros(len(seed) + 1, np.int64)
                    np.cumsum((first_in[seed[1:]] != first_in[seed[:-1]]) | (line[seed[1:]] != line[seed[:-1]]),
                              out=turns[1:-1])
                    np.cumsum(~alike[seed], out=other[1:])
                    wanted &= (turns[inner - 1:inner - 1 + len(at)] != turns[:len(at)]) | (
                        other[inner:inner + len(at)] != other[:len(at)])
                at = at[wanted]
            if len(at):
                where.append(at)
                rows.append(np.full(len(at), i))
        if rows:
            at, row = np.concatenate(where), np.concatenate(rows)
            run = shingles_at(hashes, places[row] + at, least).view(np.int64)
            order, first, step, times = _series(row, run, at)
            row, run, at = row[order][first], run[order][first], at[order][first]
            yield pa.record_batch({"run": run, "doc_id": ids[row], "place": at.astype(np.int32),
                                   "step": step.astype(np.int32), "times": times.astype(np.int32)})


def _series(row: np.ndarray, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of one run in one text at equal distances make one series: an order of the places, where in it each
    series begins, its distance (0 for one place) and its number of places. Places ascend in each text."""
    order = np.lexsort((run, row))
    row, run, at = row[order], run[order], at[order]
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (row[1:] == row[:-1]) & (run[1:] == run[:-1])
    gap = np.zeros(len(at), np.int64)
    gap[1:] = np.where(again[1:], np.diff(at), 0)
    new = ~again
    new[1:] |= again[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(at)))
    return order, first, np.where(times > 1, gap[np.minimum(first + 1, len(at) - 1)], 0), times


def _every_place(at: np.ndarray, step: np.ndarray, times: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places of all series, one series after the other, and for each place the ``values`` of its series."""
    at, step, times = (c.astype(np.int64) for c in (at, step, times))
    if (times == 1).all():
        return at, *values
    at, step, before, *values = (np.repeat(c, times) for c in (at, step, np.cumsum(times) - times, *values))
    return at + step * (np.arange(len(at)) - before), *values


def _in_step(x: np.ndarray, y: np.ndarray, step: np.ndarray, times: np.ndarray, least: int) -> np.ndarray:
    """For runs of one document in order, matched with a series of places each, the place in line with the runs before."""
    places, lines = [], {}  # the last run on each line that may go on, the oldest first
    for at, low, by, n in zip(x.tolist(), y.tolist(), step.tolist(), times.tolist()):
        lines = {line: last for line, last in lines.items() if at - last <= least}
        line = next((d for d in lines if low <= at + d <= low + by * (n - 1) and (at + d - low) % (by or 1) == 0), low - at)
        lines[line] = at
        places.append(at + line)
    return np.array(places, np.int64)


def _stretches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Matched runs of one pair of documents on one diagonal that touch make one stretch of equal words.

    A run that the source repeats is matched where it prolongs a stretch, so periodic text is one stretch as well.
    """
    held: list[list[np.ndarray]] = []
    for group in grouped(batches, ["doc_id"]):
        x, source, y, source_step, source_times = _every_place(*(group[c].to_numpy().astype(np.int64) for c in (
            "place", "step", "times", "source", "source_place", "source_step", "source_times")))
        for s in distinct(source[source_times > 1]):
            own = np.flatnonzero(source == s)
            own = own[np.argsort(x[own])]
            y[own] = _in_step(x[own], y[own], source_step[own], source_times[own], least)
        order = np.lexsort((x, y - x, source))
        source, x, y = source[order], x[order], y[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (np.diff(source) != 0) | (np.diff(y - x) != 0) | (np.diff(x) > least)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        held.append([np.full(len(first), group["doc_id"][0].as_py()), source[first], x[first], x[last] + least - 1,
                     y[first], y[last] + least - 1, x[last] - x[first] + least])
        if len(held) >= 2000:
            yield _stretch_rows(held)
            held = []
    if held:
        yield _stretch_rows(held)


def _stretch_rows(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    names = ["doc_id", "source", "first_word", "last_word", "source_first_word", "source_last_word", "n_equal"]
    return pa.record_batch([pa.array(np.concatenate(c), _TYPES[n]) for n, c in zip(names, zip(*held))], names=names)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact stretches of a document that none of its aligned passages holds."""
    for group in grouped(batches, ["doc_id"]):
        exact = group["exact"].to_numpy()
        if not exact.any():
            continue
        first, last = (group[c].to_numpy() for c in ("first_word", "last_word"))
        keep = exact.copy()
        if not exact.all():
            order = np.flatnonzero(~exact)[np.argsort(first[~exact], kind="stable")]
            reach = np.maximum.accumulate(last[order])
            before = np.searchsorted(first[order], first, "right") - 1
            keep &= (before < 0) | (reach[np.maximum(before, 0)] < last)
        yield from group.filter(pa.array(keep)).drop_columns("exact").to_batches()


def best_chains(
    x: list[int], y: list[int], extent: list[int] | None = None, weight: list[int] | None = None,
    gap_cost: float = GAP_COST,
) -> list[list[int]]:
    """Split matches, sorted by ``(x, y)``, into chains that rise in both, best first.

    A match may reach on for ``extent`` words, which the next one does not share, and
    count for ``weight`` seeds. A chain scores ``SEED`` per seed less ``gap_cost`` for each word between two
    matches on either side. The tree keeps, for every prefix of the places in y,
    the best score so far freed of the part of the gap cost that depends on the
    earlier match, so one prefix maximum finds the best predecessor.
    """
    shared = 2 * gap_cost * (SEED if extent is None else 1)
    extent, weight = extent or [0] * len(x), weight or [1] * len(x)
    ranks = sorted({b + e for b, e in zip(y, extent)})
    size = len(ranks)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    ended: list[tuple[int, int]] = []
    for j in range(len(x)):
        while ended and ended[0][0] < x[j]:  # matches that have ended before this one begins can precede it
            _, k = heappop(ended)
            end = y[k] + extent[k]
            entry, r = (score[k] + gap_cost * (x[k] + extent[k] + end), k), bisect_left(ranks, end) + 1
            while r <= size:
                if tree[r][1] < 0 or entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        r, best = bisect_left(ranks, y[j]), (-1e18, -1)
        while r > 0:
            if tree[r][1] >= 0 and tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - gap_cost * (x[j] + y[j]) + shared if best[1] >= 0 else -1.0
        score[j] = SEED * weight[j] + max(0.0, gain)
        before[j] = best[1] if gain > 0 else -1
        heappush(ended, (x[j] + extent[j], j))
    used, chains = [False] * len(x), []
    for j in sorted(range(len(x)), key=lambda j: (-score[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            chains.append(chain[::-1])
    return chains


def _in_line(x: list[int], y: list[int]) -> list[list[int]]:
    """Matches whose places move together by a window's length at most make one fragment; places in order of x, then y."""
    order = sorted(range(len(x)), key=lambda i: (y[i] - x[i], x[i]))
    fragments: list[list[int]] = []
    for i in order:
        last = fragments[-1][-1] if fragments else -1
        if last >= 0 and y[i] - x[i] == y[last] - x[last] and x[i] - x[last] <= WINDOW:
            fragments[-1].append(i)
        else:
            fragments.append([i])
    return sorted(fragments, key=lambda f: (x[f[0]], y[f[0]]))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ["doc_id", "source", "chain", "xs", "ys"]
    rows: list[tuple] = []
    for group in grouped(batches, ["doc_id", "source"]):
        doc, source = group["doc_id"][0].as_py(), group["source"][0].as_py()
        x, y = _anchors(*_every_place(*(group[c].to_numpy() for c in ("place", "step", "times", "source_place", "n"))))
        parts = _in_line(x, y)
        chains = best_chains([x[p[0]] for p in parts], [y[p[0]] for p in parts], [x[p[-1]] - x[p[0]] + SEED - 1 for p in parts],
                             [len(p) for p in parts])
        for number, fragments in enumerate(chains):
            chain = [i for f in fragments for i in parts[f]]
            if len(chain) > 1:
                rows.append((doc, source, number, [x[i] for i in chain], [y[i] for i in chain]))
        if len(rows) >= 2000:
            yield _rows(rows, fields)
            rows = []
    if rows:
        yield _rows(rows, fields)


def _anchors(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of matched seeds, and of seeds at every second seed's length of longer matches and at their ends, in order."""
    steps = (n - SEED) // (2 * SEED) + 1
    more = (n - SEED) % (2 * SEED) > 0
    total = steps + more
    inside = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    at = np.minimum(inside * 2 * SEED, np.repeat(n - SEED, total))
    pairs = sorted({*zip((np.repeat(x, total) + at).tolist(), (np.repeat(y, total) + at).tolist())})
    return [p[0] for p in pairs], [p[1] for p in pairs]


_TYPES = {"doc_id": pa.int64(), "source": pa.int64(), "chain": pa.int32(), "xs": pa.list_(pa.int32()),
          "ys": pa.list_(pa.int32()), "first_word": pa.int32(), "last_word": pa.int32(),
          "source_first_word": pa.int32(), "source_last_word": pa.int32(), "n_equal": pa.int32()}


def _rows(rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, _TYPES[f]) for f, c in zip(fields, zip(*rows))], names=fields)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of whole texts in blocks of ``BLOCK`` words, 32 bits each."""
    for batch in small_batches(batches, size=BATCH_BYTES):
        places, hashes = word_hashes(batch.column("text"))
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        ids = batch.column("doc_id").to_pylist()
        owners, numbers, data = [], [], []
        for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
            for number, at in enumerate(range(int(a), int(b), BLOCK)):
                owners.append(ids[i])
                numbers.append(number)
                data.append(short[at:min(at + BLOCK, int(b))].tobytes())
        if owners:
            yield pa.record_batch({"owner": pa.array(owners, pa.int64()), "block": pa.array(numbers, pa.int32()),
                                   "words": pa.array(data, pa.binary())})


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Equal words, in order, of two short stretches: a longest common subsequence."""
    if len(a) == len(b):
        same = np.flatnonzero(a == b)
        if 2 * len(same) >= len(a):
            return same.tolist(), same.tolist()
    if not len(a) or not len(b):
        return [], []
    if len(a) * len(b) > MAX_GAP_CELLS:
        return _long_gap(a, b)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.where(b == a[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    left, right = [], []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return left, right


def _subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        np.maximum.accumulate(np.where(b == word, row[:-1] + 1, row[1:]), out=row[1:])
    return row


def _long_gap(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """:func:`_gap` in memory that grows with the lengths, not their product (Hirschberg, 1975).

    Equal words at both ends are matched first; what lies between is halved until a table of it is small.
    """
    size = min(len(a), len(b))
    begin = _equal(a[:size], b[:size])
    end = _equal(a[begin:][::-1][:size - begin], b[begin:][::-1][:size - begin])
    left, right = list(range(begin)), list(range(begin))
    a_end, b_end = len(a) - end, len(b) - end
    inner_a, inner_b = a[begin:a_end], b[begin:b_end]
    if len(inner_a) * len(inner_b) <= MAX_GAP_CELLS:
        parts = [(0, 0, inner_a, inner_b)]
    elif len(inner_a) == 1 or len(inner_b) == 1:
        i, j = np.flatnonzero(np.isin(inner_a, inner_b))[:1], np.flatnonzero(np.isin(inner_b, inner_a))[:1]
        left, right = left + (i + begin).tolist(), right + (j + begin).tolist()
        parts = []
    else:
        middle = len(inner_a) // 2
        cut = int(np.argmax(_subsequences(inner_a[:middle], inner_b)
                            + _subsequences(inner_a[middle:][::-1], inner_b[::-1])[::-1]))
        parts = [(0, 0, inner_a[:middle], inner_b[:cut]), (middle, cut, inner_a[middle:], inner_b[cut:])]
    for a_at, b_at, part_a, part_b in parts:
        i, j = _gap(part_a, part_b)
        left += [v + begin + a_at for v in i]
        right += [v + begin + b_at for v in j]
    left += range(a_end, len(a))
    right += range(b_end, len(b))
    return left, right


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two stretches have in common from their beginning."""
    other = np.flatnonzero(a != b)
    return int(other[0]) if len(other) else len(a)


def _one_diagonal(a: np.ndarray, b: np.ndarray, xs: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words along a chain whose matches all lie ``shift`` words apart, as :func:`aligned_passages` pairs them."""
    begin = int(xs[0]) - min(int(xs[0]), int(xs[0]) + shift, MARGIN)
    end = int(xs[-1]) + SEED
    stop = end + min(len(a) - end, len(b) - end - shift, MARGIN)
    same = a[begin:stop] == b[begin + shift:stop + shift]
    at = xs - begin
    same[(at[:, None] + np.arange(SEED)).ravel()] = True
    left = np.flatnonzero(same) + begin
    right = left + shift
    if len(left) == len(same):
        return left, right
    wrong = np.zeros(len(same) + 1, np.int64)
    np.cumsum(~same, out=wrong[1:])
    open_at, close_at = at[:-1] + SEED, at[1:]
    gaps = np.flatnonzero(open_at < close_at)
    for g in gaps[wrong[close_at[gaps]] > wrong[open_at[gaps]] + 1].tolist():
        other = np.flatnonzero(~same[open_at[g]:close_at[g]]) + int(open_at[g])
        low, high = int(other[0]) + begin, int(other[-1]) + 1 + begin
        if 2 * (high - low - len(other)) >= high - low:
            continue
        i, j = _gap(a[low:high], b[low + shift:high + shift])
        before, behind = np.searchsorted(left, low), np.searchsorted(left, high)
        left = np.concatenate([left[:before], np.array(i, np.int64) + low, left[behind:]])
        right = np.concatenate([right[:before], np.array(j, np.int64) + low + shift, right[behind:]])
    return left, right


def aligned_passages(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], least: int, percent: int
                     ) -> list[tuple[int, int, int, int, int]]:
    """``(first, last, first in b, last in b, equal words)`` of the passages along one chain, places from 0."""
    x_all = np.asarray(xs, dtype=np.int64)
    shifts = np.asarray(ys, dtype=np.int64) - x_all
    if len(x_all) and (shifts == shifts[0]).all() and (x_all[1:] > x_all[:-1]).all():
        return _passages(*_one_diagonal(a, b, x_all, int(shifts[0])), least, percent)
    left: list[int] = []
    right: list[int] = []
    x_end = y_end = None
    for k, (x, y) in enumerate(zip(xs, ys)):
        if x_end is None:
            reach = min(x, y, MARGIN)
            same = np.flatnonzero(a[x - reach:x] == b[y - reach:y])
            left += (same + x - reach).tolist()
            right += (same + y - reach).tolist()
        else:
            skip = max(0, x_end - x, y_end - y)
            if skip >= SEED:
                continue
            x, y, size = x + skip, y + skip, SEED - skip
            # Equal words next to either match belong to it; where both claim the same ones, the chain is cut.
            room = min(x - x_end, y - y_end)
            on = _equal(a[x_end:x_end + room], b[y_end:y_end + room])
            back = _equal(a[x - room:x][::-1], b[y - room:y][::-1])
            if on + back > room:
                if x - x_end != y - y_end:
                    return aligned_passages(a, b, xs[:k], ys[:k], least, percent) + aligned_passages(
                        a, b, xs[k:], ys[k:], least, percent)
                back = room - on
            i, j = _gap(a[x_end + on:x - back], b[y_end + on:y - back])
            for places, begin, end, inner in ((left, x_end, x, i), (right, y_end, y, j)):
                places += range(begin, begin + on)
                places += [begin + on + v for v in inner]
                places += range(end - back, end)
        size = SEED if x_end is None else size
        left += range(x, x + size)
        right += range(y, y + size)
        x_end, y_end = x + size, y + size
    reach = min(len(a) - x_end, len(b) - y_end, MARGIN)
    same = np.flatnonzero(a[x_end:x_end + reach] == b[y_end:y_end + reach])
    left += (same + x_end).tolist()
    right += (same + y_end).tolist()
    return _passages(np.array(left, np.int64), np.array(right, np.int64), least, percent)


def _passages(left: np.ndarray, right: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """The passages among paired places: equal words score, unequal or skipped ones cost as much as the share allows."""
    cost = percent / (100 - percent)
    if not len(left):
        return []
    # Runs without a gap score as a whole.
    steps = np.maximum(np.diff(left), np.diff(right)) - 1
    cuts = np.flatnonzero(steps)
    firsts, lasts = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(left) - 1]
    losses = [0.0, *(cost * steps[cuts]).tolist()]
    found, begin = [], 0
    while begin < len(firsts):
        total, top, top_at = 0.0, 0.0, begin
        for k in range(begin, len(firsts)):
            if k > begin:
                total -= losses[k]
                if total < 0 or top - total > cost * least:
                    break
            total += lasts[k] - firsts[k] + 1
            if total >= top:
                top, top_at = total, k
        first, last = firsts[begin], lasts[top_at]
        n, m = left[last] - left[first] + 1, right[last] - right[first] + 1
        if n >= least and (last - first + 1) * 100 >= percent * max(n, m):
            found.append((int(left[first]), int(left[last]), int(right[first]), int(right[last]), last - first + 1))
        # What lies behind the best end is searched again: it may hold further passages.
        begin = top_at + 1
    return found


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of 32-bit words begin and end, and all words."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return (ends - ends[0]) // 4, np.frombuffer(raw.tobytes(), np.uint32)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of a list column begin and end, NULL as empty, and all values."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.append(0, np.cumsum(counts, dtype=np.int64)), column.flatten().to_numpy().astype(np.int64)


def _align(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    fields = ["doc_id", "source", "first_word", "last_word", "source_first_word", "source_last_word", "n_equal"]
    rows: list[tuple] = []
    for batch, cuts in whole_groups(batches, ["doc_id", "source", "chain"]):
        docs, sources, sides, blocks = (batch.column(c).to_numpy() for c in ("doc_id", "source", "side", "block"))
        ends, data = _binary(batch.column("words"))
        anchors = [_lists(batch.column(c)) for c in ("xs", "ys")]
        for first, stop in zip(cuts, cuts[1:]):
            # Rows come by side and block, the anchors with the first one.
            turn = first + int(np.searchsorted(sides[first:stop], 1))
            a, b = data[ends[first]:ends[turn]], data[ends[turn]:ends[stop]]
            a0, b0 = int(blocks[first]) * BLOCK, int(blocks[turn]) * BLOCK
            xs, ys = (values[at[first]:at[first + 1]] - low for (at, values), low in zip(anchors, (a0, b0)))
            for p in aligned_passages(a, b, xs.tolist(), ys.tolist(), least, percent):
                rows.append((int(docs[first]), int(sources[first]), p[0] + a0, p[1] + a0, p[2] + b0, p[3] + b0, p[4]))
        if len(rows) >= 5000:
            yield _rows(rows, fields)
            rows = []
    if rows:
        yield _rows(rows, fields)


def repeated_passages(documents: DataFrame, least: int = 50, percent: int = 80) -> DataFrame:
    """One row per passage of a document that an earlier document (smaller doc_id) holds too.

    ``doc_id, first_word, last_word`` (places from 0, both included), ``source``,
    the earlier document, its ``source_first_word, source_last_word``, and
    ``n_equal`` words on which both agree. A passage has at least ``least`` words,
    of which at least ``percent`` agree. Words are runs of bytes other than space
    and 0x09-0x0D, A-Z count as a-z.

    Every exactly repeated run of ``least`` words is found (for ``least`` of at
    least ``SEED + WINDOW - 1``); one with changes is found where two seeds survive
    whose first occurrences lie in one document, or next to such a run. Repetition
    inside one document does not count. Texts that are NULL, empty or shorter, and rows without a doc_id, give
    no rows; rows that share a doc_id count once, by their smallest text. Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession)
    source = _one_text_each(documents)
    seeds = scratch.write(source.mapInArrow(
        partial(_seeds, least=least), "seed long, doc_id long, place int, step int, times int, context int"))
    firsts = seeds.groupBy("seed").agg(
        F.min(F.struct("doc_id", "place", "context")).alias("f"), F.max("doc_id").alias("last")).filter(
        F.col("last") != F.col("f.doc_id")).select(
        "seed", F.col("f.doc_id").alias("source"), F.col("f.place").alias("source_place"),
        F.col("f.context").alias("source_context"))
    located = scratch.write(seeds.drop("context").join(firsts, "seed").drop("seed"))
    scratch.drop(seeds)
    seeded = located.filter(F.col("doc_id") != F.col("source")).select(
        "doc_id", "source", "place", "step", "times", "source_place", F.lit(SEED).alias("n"))
    aligned = scratch.write(_aligned(scratch, source, seeded, least, percent))
    stretches = _exact_stretches(scratch, source, located, least)
    missed = scratch.write(_still_open(aligned, stretches))
    if missed.isEmpty():
        return aligned
    # The seeds of a pair are chained anew with its stretches.
    pairs = missed.select("doc_id", "source").distinct()
    again = missed.select(
        "doc_id", "source", F.col("first_word").alias("place"), F.lit(0).alias("step"), F.lit(1).alias("times"),
        F.col("source_first_word").alias("source_place"), F.col("n_equal").alias("n"))
    more = scratch.write(_aligned(
        scratch, source, seeded.join(pairs, ["doc_id", "source"], "left_semi").unionByName(again), least, percent))
    scratch.drop(located)
    return aligned.join(pairs, ["doc_id", "source"], "left_anti").unionByName(more).unionByName(
        _still_open(more, missed))


FOUND = "doc_id long, source long, first_word int, last_word int, source_first_word int, source_last_word int, n_equal int"


def _still_open(aligned: DataFrame, stretches: DataFrame) -> DataFrame:
    """The equal stretches that no aligned passage of their document holds."""
    return aligned.withColumn("exact", F.lit(False)).unionByName(stretches.withColumn("exact", F.lit(True))).repartition(
        "doc_id").sortWithinPartitions("doc_id").mapInArrow(_uncovered, FOUND)


def _aligned(scratch: Scratch, source: DataFrame, matches: DataFrame, least: int, percent: int) -> DataFrame:
    """The passages along the chains of ``matches(doc_id, source, place, step, times, source_place, n)``."""
    chained = scratch.write(matches.repartition("doc_id").sortWithinPartitions("doc_id", "source").mapInArrow(
        _chains, "doc_id long, source long, chain int, xs array<int>, ys array<int>"))

    def asked(side: int, owner: str, places: str) -> DataFrame:
        low = F.greatest(F.lit(0), F.floor((F.element_at(places, 1) - MARGIN) / BLOCK))
        high = F.floor((F.element_at(places, -1) + SEED + MARGIN) / BLOCK)
        block = F.col("block").cast("int")
        row = chained.select("doc_id", "source", "chain", "xs", "ys", F.col(owner).alias("owner"),
                             F.lit(side).alias("side"), low.cast("int").alias("low"),
                             F.explode(F.sequence(low, high)).alias("block"))
        # The anchors travel once, with the first block of the later document.
        carries = (F.col("block") == F.col("low")) & F.lit(side == 0)
        return row.select("doc_id", "source", "chain", "owner", "side", block.alias("block"),
                          F.when(carries, F.col("xs")).alias("xs"), F.when(carries, F.col("ys")).alias("ys"))

    wanted = asked(0, "doc_id", "xs").unionByName(asked(1, "source", "ys"))
    owners = chained.select(F.explode(F.array("doc_id", "source")).alias("owner")).distinct()
    blocks = source.join(owners, source["doc_id"] == owners["owner"], "left_semi").mapInArrow(
        _blocks, "owner long, block int, words binary")
    return (
        wanted.join(blocks, ["owner", "block"])
        .select("doc_id", "source", "chain", "side", "block", "words", "xs", "ys")
        .repartition("doc_id", "source", "chain").sortWithinPartitions("doc_id", "source", "chain", "side", "block")
        .mapInArrow(partial(_align, least=least, percent=percent), FOUND))


def _exact_stretches(scratch: Scratch, source: DataFrame, located: DataFrame, least: int) -> DataFrame:
    """Equal stretches, in the columns of passages, made of runs of ``least`` words and their first occurrence."""
    repeated = located.groupBy("doc_id").agg(F.collect_list(
        F.struct("place", "step", "times", "source", "source_place", "source_context")).alias("repeated"))
    runs = scratch.write(source.join(repeated, "doc_id").mapInArrow(
        partial(_runs, least=least), "run long, doc_id long, place int, step int, times int"))
    firsts = runs.groupBy("run").agg(
        F.min(F.struct("doc_id", "place", "step", "times")).alias("f"), F.max("doc_id").alias("last")).filter(
        F.col("last") != F.col("f.doc_id")).select("run", F.col("f.doc_id").alias("source"), *[
            F.col(f"f.{c}").alias(f"source_{c}") for c in ("place", "step", "times")])
    matched = runs.join(firsts, "run").filter(F.col("doc_id") != F.col("source")).drop("run")
    return matched.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(
        partial(_stretches, least=least), FOUND)


def _one_text_each(documents: DataFrame) -> DataFrame:
    """``doc_id, text``, one row per id: its smallest text where an id is repeated."""
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text")).filter("doc_id IS NOT NULL")
    repeated = source.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return source
    return source.join(repeated, "doc_id", "left_anti").unionByName(
        source.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def without_passages(documents: DataFrame, least: int = 50, percent: int = 80) -> DataFrame:
    """``documents`` with the later copies of repeated passages cut out of ``text``; all columns and rows stay.

    A cut passage and the white space before it go. A column ``n_chars`` is set
    to the new number of characters where the table has one.
    """
    scratch = Scratch(documents.sparkSession)
    found = scratch.write(repeated_passages(documents, least, percent))
    spans = found.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.sort_array(F.collect_set(F.struct("first_word", "last_word"))).alias("_spans"))
    same = documents["doc_id"] == spans["_doc"]
    if not documents.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty():
        # Under a repeated id only the text that was searched is cut.
        searched = _one_text_each(documents).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
        spans = spans.join(searched, F.col("_doc") == F.col("_id")).drop("_id")
        same = same & (F.xxhash64(documents["text"]) == spans["_hash"])
    touched = documents.join(spans, same, "left")
    pruned = touched.withColumn("text", _cut("text", "_spans"))
    if "n_chars" in documents.columns:
        pruned = pruned.withColumn("n_chars", F.when(
            F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return pruned.select(*documents.columns)


def _cut(text: str, spans: str):
    @F.arrow_udf("string")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        touched = pc.is_valid(places)
        searched = texts.filter(touched)
        first_words, _, starts, stops = word_spans(searched)
        ends, raw = text_buffers(searched)
        new = []
        for i, found in enumerate(places.filter(touched).to_pylist()):
            kept, at = [], int(ends[i])
            for span in found:
                first = first_words[i] + span["first_word"]
                begin = int(stops[first - 1]) if span["first_word"] else int(ends[i])
                if begin > at:
                    kept.append(raw[at:begin].tobytes())
                at = max(at, int(stops[first_words[i] + span["last_word"]]))
            kept.append(raw[at:int(ends[i + 1])].tobytes())
            text = b"".join(kept).decode()
            new.append(text.lstrip() if found[0]["first_word"] == 0 else text)
        return pc.replace_with_mask(texts, touched, pa.array(new, texts.type))

    return cut(F.col(text), F.col(spans))


@query("op8_repeated_passages")
def _repeated_passages(spark, folder):
    return repeated_passages(table(spark, folder, "documents"))
