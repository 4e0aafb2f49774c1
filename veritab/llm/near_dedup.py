"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification.

Every distinct shingle set gets a SetSketch (Ertl, 2021) with exponentially
spaced registers: each shingle is a stream of exponential arrival times dealt to
the registers, and a register keeps ``floor(1 - log_b(earliest arrival))``. Two
sketches merge by the larger register, so sketches of parts make the sketch of
the whole. Equal registers are as likely as the sets are alike, so bands of
registers find candidates; the likelihood of the counts of larger, smaller and
equal registers, given both set sizes, estimates the similarity of a pair; what
may reach the threshold is verified on the full sets.

Groups of copies are never expanded into all their pairs. Equal sets are one
class, and classes that share a band value are linked by
:mod:`veritab.llm.linking`: the pairs that share most bands and are likely are
verified first, then all pairs of different components that their parity bits
leave open, so no link between classes that share a band is lost. Classes at
similarity 0.8 share none with probability 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, table
from veritab.llm.linking import components, links, parity_bits, with_sides
from veritab.llm.words import distinct, mix, shingle_hashes, small_batches, word_hashes

BANDS = 48
BAND_ROWS = 6
REGISTERS = 480  # the first BANDS * BAND_ROWS of them make bands
BASE = 1.001
RATE = 20.0
LIMIT = 65_534
SLACK = 0.06
BATCH_BYTES = 2 << 20


def set_sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers for each set of distinct element hashes; empty sets give zeros.

    Element arrivals are a Poisson stream of rate ``RATE * registers`` whose
    points go to registers at random: the same law as one exponential variable
    for each element and register, but only arrivals early enough to matter are
    drawn.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    earliest = np.full(len(sets) * registers, np.inf)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    at = np.zeros(len(elements))
    scale = 1.0 / (RATE * registers)
    step = 0
    while len(elements):
        step += 1
        drawn = mix(elements + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log1p(-(drawn >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) * scale
        slot = owner * registers + ((drawn & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(earliest, slot, at)
        if step < 4:
            continue
        last = earliest.reshape(-1, registers).max(axis=1)
        alive = at < last[owner]
        elements, owner, at = elements[alive], owner[alive], at[alive]
    with np.errstate(divide="ignore"):
        values = np.floor(1.0 - np.log(earliest) / np.log(BASE))
    return np.clip(values, 0, LIMIT + 1).reshape(len(sets), registers).astype(np.uint16)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches, given the set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    total = (size_a + size_b).astype(np.float64)
    u, v = size_a / total, size_b / total
    top = np.minimum(u / v, v / u)
    low, high = np.zeros(len(top)), top.copy()

    def smaller(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p_up, p_down = smaller(u - v * j), smaller(v - u * j)
        tiny = 1e-12
        return (up * np.log(np.maximum(p_up, tiny)) + down * np.log(np.maximum(p_down, tiny))
                + same * np.log(np.maximum(1.0 - p_up - p_down, tiny)))

    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def _document_sets(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    places, hashes = word_hashes(batch.column("text"))
    return [distinct(shingle_hashes(hashes[a:b], shingle)) for a, b in zip(places[:-1], places[1:])]


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, size=BATCH_BYTES):
        sets = _document_sets(batch, shingle)
        sketches = set_sketches(sets)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([_digest(s) for s in sets], pa.binary()),
            "sketch": pa.array([s.tobytes() for s in sketches], pa.binary()),
        })


def _digest(elements: np.ndarray) -> bytes:
    """128 bits that stand for a set: two independent sums over its scrambled elements."""
    with np.errstate(over="ignore"):
        first, second = mix(elements).sum(dtype=np.uint64), mix(~elements * np.uint64(3)).sum(dtype=np.uint64)
    return int(first).to_bytes(8, "little") + int(second).to_bytes(8, "little")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _band_keys(_matrix(batch.column("sketch")))
        yield pa.record_batch({
            "key": pa.array(keys.ravel()),
            "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)),
        })


def _band_keys(sketches: np.ndarray) -> np.ndarray:
    registers = sketches[:, :BANDS * BAND_ROWS].reshape(len(sketches), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15),
                           (len(sketches), BANDS))
    for i in range(BAND_ROWS):
        keys = mix(keys + registers[:, :, i].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return keys.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _full_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sets of the rows that stand for their digest; a repeated id may come with another text."""
    for batch in small_batches(batches, size=BATCH_BYTES):
        wanted = batch.column("digest").to_pylist()
        sets = _document_sets(batch, shingle)
        kept = [i for i, s in enumerate(sets) if _digest(s) == wanted[i]]
        yield pa.record_batch({
            "rep": batch.column("doc_id").take(pa.array(kept, pa.int64())),
            "n": pa.array([len(sets[i]) for i in kept], pa.int64()),
            "bits": pa.array([parity_bits(sets[i]) for i in kept], pa.binary()),
            "elements": pa.array([sets[i].tobytes() for i in kept], pa.binary())})


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches make the threshold likely enough to be verified at once."""
    for batch in batches:
        if batch.num_rows:
            guess = joint_similarity(*[_matrix(batch.column(c)) for c in ("sketch_a", "sketch_b")],
                                     *[batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            keep = pa.array(guess >= percent / 100 - SLACK)
            yield pa.record_batch({c: batch.column(c).filter(keep) for c in ("a", "b")})


def near_duplicates(documents: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents(doc_id, text)``.

    Texts are compared by their sets of ``shingle``-word runs (words are runs of
    bytes other than space and 0x09-0x0D, A-Z count as a-z; fewer words make one
    run). Rows whose sets share ``percent`` of their union are linked;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks it.

    Texts that are NULL, empty or without words have an empty set, are linked
    with nothing and are kept. Rows without a doc_id are linked with nothing:
    their component is NULL and they are kept. Repeated rows share a doc_id and so
    a component, and all rows of the kept id are kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession)
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text"))
    signed = scratch.write(source.mapInArrow(
        partial(_sign, shingle=shingle), "doc_id long, n long, digest binary, sketch binary"))
    usable = signed.filter("doc_id IS NOT NULL AND n > 0")
    first = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = scratch.write(
        usable.join(first, "digest").filter(F.col("doc_id") == F.col("rep")).dropDuplicates(["rep"])
        .select("rep", "n", "sketch", "digest"))
    bands = reps.mapInArrow(_bands, "key long, rep long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = scratch.write(bands.join(shared, "key"))
    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "digest")
    sets = scratch.write(source.join(wanted, "doc_id").mapInArrow(
        partial(_full_sets, shingle=shingle), "rep long, n long, bits binary, elements binary").dropDuplicates(["rep"]))

    def likely(pairs: DataFrame) -> DataFrame:
        return with_sides(pairs, reps, "n", "sketch").mapInArrow(partial(_likely, percent=percent), "a long, b long")

    found = links(scratch, members, sets, percent, likely)
    # A repeated id may stand for different sets: its row in another class links the two.
    same_id = usable.join(first, "digest").filter(F.col("doc_id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(scratch, found.unionByName(same_id).distinct())
    result = signed.select("doc_id", "n").join(roots, signed["doc_id"] == roots["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_WORDS = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


@query("op9_near_duplicates", NEAR_SQL)
def _near_duplicates(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
