"""Connect sets that share keys, exactly, without listing all pairs of a group.

Groups of alike sets hold as many pairs as the square of their size, but what
connects them is one link less than their number. Keys whose members all share
one larger key, their home, are left out, and two sets of one home are compared
there alone. First every set is compared with a few of those that each key names
to all its members, the ones it shares most keys with. Then only keys count whose
members still lie in several components, and only members outside a key's
largest component ask. A task compares two blocks of members by their parity
bits: each set sets or clears bits of a bitmap by its elements, and two bitmaps
differ in no more places than the sets have elements of their own, so a pair
whose bitmaps differ too much is no link. A task offers the pairs that may
be links if they are few for its members, else some forests of them, the closest
first, so that what it offers grows with its members only. Offered pairs are
compared on the full sets and the rounds end when every task has offered all its
pairs; each round offers more forests, so that a family just below the threshold
cannot take many rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.llm.base import Scratch
from veritab.llm.words import grouped, mix

BLOCK_MEMBERS = 4096
FIRST_PAIRS = 3
FIRST_FORESTS = 16


def parity_bits(elements: np.ndarray) -> bytes:
    """A bitmap of two to four bits an element, in which each element flips one bit."""
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length())
    slots = (mix(elements) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def unlike_places(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many places a bitmap differs from each of several; the longer ones are folded to the shorter length."""
    while many.shape[1] > len(one):
        many = many[:, :many.shape[1] // 2] ^ many[:, many.shape[1] // 2:]
    while len(one) > many.shape[1]:
        one = one[:len(one) // 2] ^ one[len(one) // 2:]
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def _words64(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def links(
    scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int,
    likely: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``a, b``: pairs with a Jaccard similarity of ``percent`` or more that connect all such pairs of one key.

    ``members`` holds distinct pairs of ``key`` and ``rep``; ``sets`` each rep's ``n``,
    ``bits`` (see :func:`parity_bits`) and ``elements`` (distinct 64-bit values in ascending
    order, as bytes) and is read several times. Two reps are connected by the result
    if and only if they are by all alike pairs that have a key in common. ``likely`` may
    pick the first pairs to compare out of those offered; the others come later.
    """
    members = scratch.write(_needed_groups(members))
    hashed = F.xxhash64("rep")
    ends = members.groupBy("key").agg(F.array_distinct(F.array(
        F.min("rep"), F.max("rep"), F.min_by("rep", hashed), F.max_by("rep", hashed))).alias("ends"))
    offers = members.join(ends, "key").select(F.col("rep").alias("x"), F.explode("ends").alias("y"))
    counted = offers.filter("x != y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y"))
    picked = counted.withColumn("rank", rank).filter(f"rank <= {FIRST_PAIRS}").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    possible = _possible(picked, sets, percent)
    judged = scratch.write(_judged(scratch.write(likely(possible) if likely else possible), sets, percent))
    forests = FIRST_FORESTS
    while True:
        roots = components(scratch, judged.filter("linked").select("a", "b"))
        pairs = scratch.write(_offered(scratch, members, roots, judged, sets, percent, forests))
        offered, more = pairs.agg(F.count(F.lit(1)), F.max("more")).first()
        if offered:
            judged = scratch.write(judged.unionByName(_judged(pairs.select("a", "b"), sets, percent)))
        if not more:
            return judged.filter("linked").select("a", "b")
        forests *= 16


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node it is connected to.

    Each round, every node of a tree takes the smallest root among its neighbours
    and then its root's root. Minima are combined before each shuffle.
    """
    both = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("root")))
    written = [state]
    while True:
        offers = both.join(state, F.col("a") == F.col("node")).groupBy("b").agg(F.min("root").alias("offer"))
        hooked = scratch.write(state.join(offers, F.col("node") == F.col("b")).select(
            "node", F.col("root").alias("before"), F.least("root", "offer").alias("root")))
        # A root's own row may have moved on; the smallest offer to any member of a tree moves its root as well.
        moves = hooked.groupBy(F.col("before").alias("tree")).agg(F.min("root").alias("to"))
        jumped = scratch.write(hooked.join(moves, F.col("root") == F.col("tree"), "left").select(
            "node", "before", F.least("root", F.coalesce("to", "root")).alias("root")))
        changed = not jumped.filter(F.col("root") != F.col("before")).isEmpty()
        scratch.drop(hooked, *written)
        written = [jumped]
        state = jumped.select("node", "root")
        if not changed:
            scratch.drop(both)
            return state


def _needed_groups(members: DataFrame) -> DataFrame:
    """``key, rep, home``, without keys that add no pair: of one member, or with all members in one larger key.

    The home of a member is the largest of its keys. Of keys with the same members
    only one is a home, so the others go as well.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = members.join(sizes, "key")
    homes = shared.groupBy("rep").agg(F.max(F.struct("size", "key"))["key"].alias("home"))
    placed = shared.select("key", "rep").join(homes, "rep")
    needed = placed.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter(
        "low != high OR low = key").select("key")
    return placed.join(needed, "key").select("key", "rep", "home")


def with_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and parity bits leave open."""
    return with_sides(pairs, sets, "n", "bits").mapInArrow(partial(_open_pairs, percent=percent), "a long, b long")


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
        open_here = 100 * np.minimum(*n) >= percent * np.maximum(*n)
        for i in np.flatnonzero(open_here).tolist():
            one, other = (_words64(batch.column(c)[i].as_py()) for c in ("bits_a", "bits_b"))
            differ = int(unlike_places(one, other[None])[0])
            open_here[i] = (100 + percent) * differ <= (100 - percent) * int(n[0][i] + n[1][i])
        yield pa.record_batch({c: batch.column(c).filter(pa.array(open_here)) for c in ("a", "b")})


def _judged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked``, decided on the full sets."""
    return with_sides(pairs, sets, "elements").mapInArrow(partial(_compare, percent=percent), "a long, b long, linked boolean")


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            both = np.concatenate([np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64)
                                   for c in ("elements_a", "elements_b")])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            linked[i] = 100 * shared >= percent * (len(both) - shared)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked)})


def _offered(
    scratch: Scratch, members: DataFrame, roots: DataFrame, judged: DataFrame, sets: DataFrame, percent: int, forests: int,
) -> DataFrame:
    """``a, b, more``: pairs of different components that may be links and have not been refused.

    Two blocks with more than ``forests`` such pairs a member offer that many forests of
    them and mark their pairs with ``more``; others offer all.
    """
    placed = scratch.write(members.join(roots, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "home", F.coalesce("root", "rep").alias("root")))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    mixed = parts.groupBy("key").agg(
        F.max(F.struct("held", "root"))["root"].alias("big"), F.sum("held").alias("size"),
        (F.sum("held") - F.max("held")).alias("outside"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    no = judged.filter("NOT linked")
    refused = no.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        no.select(F.col("b").alias("rep"), F.col("a").alias("other"))).groupBy("rep").agg(
        F.collect_set("other").alias("refused"))
    stray = F.col("root") != F.col("big")
    askers = F.ceil(F.col("outside") / BLOCK_MEMBERS).cast("int")
    pools = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    live = placed.join(mixed, "key").withColumn("stray", stray)
    fields = ["key", "rep", "home", "root", "stray", "asker", "pool", "asks"]
    hashed = F.xxhash64("rep")
    pool = live.withColumn("pool", F.pmod(hashed, pools).cast("int")).withColumn(
        "asker", F.explode(F.sequence(F.lit(0), askers - 1))).withColumn("asks", F.lit(False)).select(*fields)
    asking = live.filter("stray").withColumn("asker", F.pmod(hashed, askers).cast("int")).withColumn(
        "pool", F.explode(F.sequence(F.lit(0), pools - 1))).withColumn("asks", F.lit(True)).select(*fields)
    dealt = pool.unionByName(asking).join(sets.select("rep", "n", "bits"), "rep").join(refused, "rep", "left")
    return dealt.repartition("key", "asker", "pool").sortWithinPartitions("key", "asker", "pool").mapInArrow(
        partial(_forests, percent=percent, forests=forests), "a long, b long, more boolean").groupBy("a", "b").agg(
        F.max("more").alias("more"))


def _forests(batches: Iterator[pa.RecordBatch], percent: int, forests: int) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, ["key", "asker", "pool"]):
        edges = _edges(group.combine_chunks(), percent)
        picked = []
        if len(edges) <= forests * group.num_rows:
            picked, edges = edges, []
        for _ in range(forests):
            tree, rest = {}, []
            for edge in edges:
                x, y = (_top(tree, r) for r in edge[3:])
                if x == y:
                    rest.append(edge)
                    continue
                tree[max(x, y)] = min(x, y)
                picked.append(edge)
            edges = rest
            if not edges:
                break
        if picked:
            yield pa.record_batch({
                "a": pa.array([e[1] for e in picked], pa.int64()), "b": pa.array([e[2] for e in picked], pa.int64()),
                "more": pa.array([bool(edges)] * len(picked))})


def _top(tree: dict[int, int], x: int) -> int:
    while x in tree:
        tree[x] = tree.get(tree[x], tree[x])
        x = tree[x]
    return x


def _edges(group: pa.Table, percent: int) -> list[tuple[int, int, int, int, int]]:
    """Differing places, ids and components of all pairs of an asker and a member that may be links, closest first."""
    asks, stray, rep, home, root, n = (group[c].to_numpy() for c in ("asks", "stray", "rep", "home", "root", "n"))
    key = group["key"][0].as_py()
    refused = group["refused"].to_pylist()
    bits = group["bits"].to_pylist()
    sizes = np.array([len(b) for b in bits])
    edges = []
    matrices = []
    for size in np.unique(sizes[~asks]).tolist():
        rows = np.flatnonzero(~asks & (sizes == size))
        matrices.append((rows, _words64(b"".join(bits[i] for i in rows.tolist())).reshape(len(rows), -1)))
    for i in np.flatnonzero(asks).tolist():
        one = _words64(bits[i])
        for rows, matrix in matrices:
            near = (root[rows] != root[i]) & (~stray[rows] | (rep[rows] > rep[i])) & (
                100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i]))
            if home[i] != key:
                near &= home[rows] != home[i]
            if refused[i]:
                near &= ~np.isin(rep[rows], refused[i])
            if not near.any():
                continue
            found = rows[near]
            differ = unlike_places(one, matrix[near])
            close = (100 + percent) * differ <= (100 - percent) * (n[found] + n[i])
            edges += [(int(d), int(min(rep[i], rep[j])), int(max(rep[i], rep[j])), int(root[i]), int(root[j]))
                      for d, j in zip(differ[close], found[close])]
    return sorted(edges)
