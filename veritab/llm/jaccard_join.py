"""Set similarity join by prefixes of token combinations (after pkwise: Wang, Xiao et al., 2016).

The tokens of a document, its distinct word shingles, are ordered by how many
documents hold them, rare ones first. Alike documents differ in few tokens, so a
prefix of one more than that shares a token with the other's prefix. Frequent
tokens make such a match worthless: many unlike documents share one. They are
therefore indexed in combinations: tokens of few documents alone, tokens of the
second frequency class by two, those of the third by three, and the prefix is
extended to match. To keep combinations few, the tokens of a class are dealt into
parts and only combined within a part. A part of ``c`` tokens loses all its
combinations of ``k`` only with ``c - k + 1`` tokens, so the prefix ends where these
numbers add up to one more than the tokens that may differ; two alike documents
then share a combination of both prefixes. Tokens that no other document holds
count in the prefix but match nothing and are not indexed.

How frequent a token is comes from counting all tokens of all distinct texts,
hashed to slots, in ranges of bounded size. The ``FREQUENT_TOKENS`` most frequent
slots are sent to all tasks; others count as rare and are indexed alone. That
table only decides what is indexed and how, the same for all documents, so its
bound and shared slots change the work and never the result.

Documents that share a combination are linked by :mod:`veritab.llm.linking`,
which verifies on full sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, table
from veritab.llm.linking import components, links, parity_bits
from veritab.llm.near_dedup import _digest, _document_sets
from veritab.llm.words import mix, small_batches

FREQUENT_TOKENS = 1 << 23
RANGE_TOKENS = 1 << 22
# Frequency classes by the bit length of the number of documents: up to 4095 alone, as one block of members holds them,
# up to 262143 by two, others by three.
CLASSES = (12, 18)
# Sets below this size index all tokens alone; larger ones deal a class into an eighth as many parts.
SMALL_SET, PART = 64, 8


def jaccard_components(
    documents: DataFrame, shingle: int = 4, percent: int = 85, most: int = FREQUENT_TOKENS,
    frequency: tuple[int, int] = CLASSES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents(doc_id, text)``.

    A text's set holds its distinct runs of ``shingle`` words (runs of bytes other than
    space and 0x09-0x0D, A-Z count as a-z; fewer words make one run as a whole). Texts
    are linked if their sets share ``percent`` of their union; ``component_id`` is the
    smallest doc_id reachable by links, the own one included.

    A NULL text, or one without words, has an empty set and is linked with nothing. A
    row without doc_id is linked with nothing and has a NULL component. Repeated rows
    give a row each; rows that repeat a doc_id with different texts link what either is
    linked with. Other columns are ignored; an empty table gives an empty result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the similarity must be 50 to 100 percent")
    scratch = Scratch(documents.sparkSession)
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text"))
    signed = scratch.write(source.mapInArrow(partial(_sign, shingle=shingle), "doc_id long, n long, digest binary"))
    usable = signed.filter("doc_id IS NOT NULL AND n > 0")
    first = scratch.write(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    chosen = source.join(first.select(F.col("rep").alias("doc_id"), "digest"), "doc_id").select("doc_id", "text", "digest")

    total = first.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, math.ceil(total / RANGE_TOKENS))
    classes = _token_classes(scratch, chosen, shingle, ranges, most)
    members = scratch.write(chosen.mapInArrow(
        partial(_signatures, shingle=shingle, percent=percent, classes=classes, frequency=frequency),
        "key long, rep long"))
    classes.destroy()
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = scratch.write(members.join(shared, "key").distinct())
    sets = scratch.write(chosen.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                         .mapInArrow(partial(_sets, shingle=shingle), "rep long, n long, bits binary, elements binary")
                         .dropDuplicates(["rep"]))
    found = links(scratch, members, sets, percent)

    copies = usable.join(first.select("digest", "rep"), "digest").filter("doc_id != rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(scratch, found.unionByName(copies).distinct())
    return signed.select("doc_id", "n").join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sets = _document_sets(batch, shingle)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([_digest(s) for s in sets], pa.binary())})


def _chosen_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets of the rows that stand for their digest; a repeated id may come with another text."""
    for batch in small_batches(batches):
        wanted = batch.column("digest").to_pylist()
        sets = _document_sets(batch, shingle)
        kept = [i for i, s in enumerate(sets) if _digest(s) == wanted[i]]
        if kept:
            ids = batch.column("doc_id").to_pylist()
            yield [ids[i] for i in kept], [sets[i] for i in kept]


def _slots(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and 32-bit slot of each token."""
    hashed = mix(tokens + np.uint64(0x9E3779B97F4A7C15))
    return hashed % np.uint64(ranges), (hashed // np.uint64(ranges)).astype(np.uint32)


class _Classes:
    """Slots of frequent tokens, range by range in ascending order, and the bit length of their number of documents."""

    def __init__(self, ranges: int, slots: np.ndarray, levels: np.ndarray, ends: np.ndarray, complete: bool):
        self.ranges, self.slots, self.levels, self.ends, self.complete = ranges, slots, levels, ends, complete

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The level of each token, 0 if its slot is not here."""
        which, slots = _slots(tokens, self.ranges)
        order = np.argsort((which << np.uint64(32)) | slots)
        which, slots = which[order], slots[order]
        found = np.zeros(len(tokens), np.uint8)
        cuts = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which)) if len(which) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = self.ends[int(which[a])], self.ends[int(which[a]) + 1]
            if low < high:
                here = self.slots[low:high]
                at = np.minimum(np.searchsorted(here, slots[a:b]), high - low - 1)
                found[a:b] = np.where(here[at] == slots[a:b], self.levels[low:high][at], 0)
        levels = np.empty_like(found)
        levels[order] = found
        return levels


def _token_classes(scratch: Scratch, chosen: DataFrame, shingle: int, ranges: int, most: int) -> Broadcast:
    """The levels of at most ``most`` slots that several documents hold, the most frequent ones."""
    packed = chosen.mapInArrow(partial(_packed_slots, shingle=shingle, ranges=ranges),
                               "`range` long, slots binary, counts binary")
    counted = scratch.write(packed.groupBy("range").applyInArrow(
        _frequent_slots, "`range` long, level int, held long, slots binary"))
    held = sorted(((r["level"], r["held"]) for r in counted.groupBy("level").agg(F.sum("held").alias("held")).collect()),
                  reverse=True)
    kept, least = 0, 1 + max((level for level, _ in held), default=1)
    for level, count in held:
        if kept + count > most:
            break
        kept, least = kept + count, level
    slots, levels, ends = np.empty(kept, np.uint32), np.empty(kept, np.uint8), np.zeros(ranges + 1, np.int64)
    at = 0
    known = counted.filter(F.col("level") >= least).groupBy("range").applyInArrow(
        _merged_slots, "`range` long, slots binary, levels binary")
    for row in known.orderBy("range").toLocalIterator():
        here = np.frombuffer(row["slots"], np.uint32)
        slots[at:at + len(here)], levels[at:at + len(here)] = here, np.frombuffer(row["levels"], np.uint8)
        at += len(here)
        ends[row["range"] + 1] = at
    return scratch.spark.sparkContext.broadcast(
        _Classes(ranges, slots, levels, np.maximum.accumulate(ends), least <= 2))


def _merged_slots(group: pa.Table) -> pa.Table:
    """All known slots of a range in ascending order."""
    parts = [np.frombuffer(x, np.uint32) for x in group["slots"].to_pylist()]
    slots = np.concatenate(parts)
    levels = np.repeat(group["level"].to_numpy().astype(np.uint8), [len(x) for x in parts])
    order = np.argsort(slots)
    return pa.table({
        "range": group["range"].slice(0, 1), "slots": pa.array([slots[order].tobytes()], pa.binary()),
        "levels": pa.array([levels[order].tobytes()], pa.binary())})


def _packed_slots(batches: Iterator[pa.RecordBatch], shingle: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """For each batch and range the slots that occur once, and those that occur more often with their counts."""
    for _, sets in _chosen_sets(batches, shingle):
        which, slots = _slots(np.concatenate(sets), ranges)
        keys, counts = np.unique((which << np.uint64(32)) | slots, return_counts=True)
        rows = {"range": [], "slots": [], "counts": []}
        for more in (False, True):
            here, n = keys[(counts > 1) == more], counts[(counts > 1) == more]
            which = (here >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(here) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(here))):
                rows["range"].append(int(which[a]))
                rows["slots"].append((here[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                rows["counts"].append(n[a:b].astype(np.int64).tobytes() if more else b"")
        yield pa.record_batch({"range": pa.array(rows["range"], pa.int64()), "slots": pa.array(rows["slots"], pa.binary()),
                               "counts": pa.array(rows["counts"], pa.binary())})


def _frequent_slots(group: pa.Table) -> pa.Table:
    """The slots of one range that several documents hold, by the bit length of their number."""
    parts, counts = [], []
    for packed, n in zip(group["slots"].to_pylist(), group["counts"].to_pylist()):
        parts.append(np.frombuffer(packed, np.uint32))
        counts.append(np.frombuffer(n, np.int64) if n else np.ones(len(parts[-1]), np.int64))
    slots, counts = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    slots, totals = slots[first], np.add.reduceat(counts, first)
    slots, totals = slots[totals > 1], totals[totals > 1]
    levels = np.frexp(totals.astype(np.float64))[1]
    found = np.unique(levels).tolist()
    return pa.table({
        "range": pa.array([group["range"][0].as_py()] * len(found), pa.int64()), "level": pa.array(found, pa.int32()),
        "held": pa.array([int((levels == x).sum()) for x in found], pa.int64()),
        "slots": pa.array([slots[levels == x].tobytes() for x in found], pa.binary())})


def _signatures(
    batches: Iterator[pa.RecordBatch], shingle: int, percent: int, classes: Broadcast, frequency: tuple[int, int],
) -> Iterator[pa.RecordBatch]:
    known = classes.value
    for ids, sets in _chosen_sets(batches, shingle):
        levels = known.of(np.concatenate(sets))
        ends = np.cumsum([len(s) for s in sets])
        made = [combinations(s, levels[end - len(s):end], percent, known.complete, frequency)
                for s, end in zip(sets, ends)]
        yield pa.record_batch({
            "key": pa.array(np.concatenate(made).view(np.int64)),
            "rep": pa.array(np.repeat(np.array(ids, np.int64), [len(m) for m in made]))})


def combinations(
    tokens: np.ndarray, levels: np.ndarray, percent: int, complete: bool, frequency: tuple[int, int] = CLASSES,
) -> np.ndarray:
    """The indexed combinations of one set, of every size class in which it can meet an alike set.

    ``levels`` are bit lengths of the tokens' numbers of documents, 0 for those that
    are rare, or, if ``complete``, that no other document holds.
    """
    n = len(tokens)
    least = -(-percent * n // 100)
    differing = n - least
    if complete and int((levels == 0).sum()) > differing:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, levels))
    tokens, levels = tokens[order], levels[order]
    base = 1 << (n.bit_length() - 1) if n >= SMALL_SET else 0
    made = [_indexed(tokens, levels, differing, base, complete, frequency)]
    while base and least < base:
        base = base // 2 if base > SMALL_SET else 0
        made.append(_indexed(tokens, levels, differing, base, complete, frequency))
    return np.unique(np.concatenate(made))


def _indexed(
    tokens: np.ndarray, levels: np.ndarray, differing: int, base: int, complete: bool, frequency: tuple[int, int],
) -> np.ndarray:
    """Single tokens and combinations of the shortest prefix that more than ``differing`` lost tokens are needed to break."""
    size = np.ones(len(tokens), np.int64)
    if base:
        size += (levels > frequency[0]).astype(np.int64) + (levels > frequency[1])
    counts = size == 1
    joined = np.flatnonzero(size > 1)
    part = size[joined] * base + (mix(tokens[joined] ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(
        max(1, base // PART))).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.append(True, part[by_part][1:] != part[by_part][:-1])) if len(part) else np.zeros(0, np.int64)
    place = np.empty(len(part), np.int64)
    place[by_part] = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
    counts[joined] = place >= size[joined] - 1
    end = int(np.searchsorted(np.cumsum(counts), differing + 1)) + 1
    alone = tokens[:end][(size[:end] == 1) & ((levels[:end] > 0) | (not complete))]
    made = [mix(alone)]
    inside = joined[by_part][joined[by_part] < end]
    part = part[by_part][joined[by_part] < end]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        k = int(size[inside[a]])
        if b - a >= k:
            hashed = mix(tokens[inside[a:b]] + np.uint64(k))
            made.append(mix(hashed[_choices(int(b - a), k)].sum(axis=1, dtype=np.uint64) + np.uint64(base * 4 + k)))
    return np.concatenate(made)


@lru_cache(maxsize=256)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for ids, sets in _chosen_sets(batches, shingle):
        yield pa.record_batch({
            "rep": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
            "bits": pa.array([parity_bits(s) for s in sets], pa.binary()),
            "elements": pa.array([s.tobytes() for s in sets], pa.binary())})


_WORDS = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")

JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2),
          lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


@query("op11_jaccard_join", JOIN_SQL)
def _jaccard_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))
