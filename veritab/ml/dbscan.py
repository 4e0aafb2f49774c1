"""Exact density-based clustering on a grid of cells.

Two points of one cell are always neighbours (the cell diagonal is below eps),
so a cell with ``min_samples`` points is core as a whole and never compares its
points with each other. Only points of thinner cells look for neighbours, and a
neighbouring cell that lies entirely within eps of such a point adds its size
without being opened. Core cells are linked by bounding boxes that are refined
level by level from pre-aggregated counts, so two crowded cells are linked
without pairing their points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ranking import dense_codes, lookup
from veritab.ml.vectors import feature_array
from veritab.schema import col
from veritab.session import checkpoint

# Neighbouring cells are found through blocks over at most this many dimensions.
GRID_DIMENSIONS = 4
# A pair of boxes with at most this many point pairs is compared point by point.
DIRECT_PAIRS = 4096
# Cells with more points than this are dealt into parts when a join has to open them.
HOT_ROWS = 1_000_000
SPLIT = 4


def _gap_low(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """Smallest distance between two boxes."""
    return _norm(F.transform(
        F.arrays_zip(F.col(a_low).alias("al"), F.col(a_high).alias("ah"), F.col(b_low).alias("bl"),
                     F.col(b_high).alias("bh")),
        lambda s: F.greatest(F.lit(0.0), s["bl"] - s["ah"], s["al"] - s["bh"])))


def _gap_high(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """Largest distance between two boxes."""
    return _norm(F.transform(
        F.arrays_zip(F.col(a_low).alias("al"), F.col(a_high).alias("ah"), F.col(b_low).alias("bl"),
                     F.col(b_high).alias("bh")),
        lambda s: F.greatest(F.abs(s["bh"] - s["al"]), F.abs(s["ah"] - s["bl"]))))


def _norm(parts: Column) -> Column:
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda total, v: total + v * v))


def _distance(a: str, b: str) -> Column:
    return _norm(F.zip_with(F.col(a), F.col(b), lambda u, v: u - v))


def _box(width: int) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.get("x", F.lit(i))) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.get("x", F.lit(i))) for i in range(width)]).alias("high"),
        F.min("key").alias("first_key"),
    ]


def _grid(side: float) -> Column:
    return F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("bigint"))


class _Parts:
    """Deals the points of the few hot cells into parts for joins on the cell.

    Hot cells hold more than one point in a thousand, so there are fewer than a
    thousand of them, and all their points are core.
    """

    def __init__(self, cells: DataFrame, hot_rows: int, min_samples: int):
        total = cells.agg(F.sum("n")).first()[0] or 0
        limit = max(hot_rows, total // 1000, min_samples)
        hot = cells.filter(F.col("n") > limit).select("cell", "n").collect()
        self.parts = {tuple(r["cell"]): math.ceil(r["n"] / limit) for r in hot}

    def _count(self, cell: Column) -> Column:
        found = F.create_map(*[
            item for c, n in self.parts.items() for item in (F.array(*[F.lit(v) for v in c]).cast("array<bigint>"), F.lit(n))
        ])
        return F.coalesce(F.try_element_at(found, cell), F.lit(1))

    def is_hot(self) -> Column:
        return self._count(F.col("cell")) > 1 if self.parts else F.lit(False)

    def points(self, df: DataFrame) -> DataFrame:
        if not self.parts:
            return df.withColumn("part", F.lit(0))
        return df.withColumn("part", F.pmod(F.xxhash64("key"), self._count(F.col("cell"))).cast("int"))

    def visitors(self, df: DataFrame, cell: str) -> DataFrame:
        if not self.parts:
            return df.withColumn("part", F.lit(0))
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), (self._count(F.col(cell)) - 1).cast("int"))))


def dbscan(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    eps: float = 0.5,
    min_samples: int = 5,
    hot_rows: int = HOT_ROWS,
    direct_pairs: int = DIRECT_PAIRS,
) -> DataFrame:
    """``(key, x, label)``: clusters numbered by their smallest core key, noise -1.

    A border row takes the lowest cluster within reach. ``key`` identifies a row.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    rows = df.select(col(key).alias("key"), feature_array(df, features).alias("x"))
    head = rows.select(F.size("x").alias("width")).first()
    if head is None:
        return rows.withColumn("label", F.lit(-1).cast("bigint"))
    width = head["width"]
    # A hair below eps / sqrt(width), so rounding cannot put points farther than eps into one cell.
    side = eps / math.sqrt(width) * (1 - 1e-9)
    points = rows.withColumn("cell", _grid(side))
    cells = checkpoint(points.groupBy("cell").agg(*_box(width)))
    parts = _Parts(cells, hot_rows, min_samples)
    near = checkpoint(_near_cells(cells, width, side, eps))

    # Core points.
    thin_cells = cells.filter(F.col("n") < min_samples)
    cool = points.filter(~parts.is_hot())
    thin = checkpoint(cool.join(thin_cells.select("cell", F.col("n").alias("own")), "cell"))
    open_cells = _point_to_cells(thin, near, cells, eps)
    known = open_cells.groupBy("key").agg(F.sum("whole").alias("whole"))
    counted = thin.join(known, "key", "left").withColumn("known", F.col("own") + F.coalesce("whole", F.lit(0)))
    unsure = counted.filter(F.col("known") < min_samples).select("key")
    visits = parts.visitors(
        open_cells.filter(F.col("partly")).join(unsure, "key", "left_semi").select(
            "key", F.col("x").alias("q"), F.col("other").alias("cell")), "cell")
    dealt = parts.points(points).select("cell", "part", "x")
    found = (
        visits.join(dealt, ["cell", "part"]).filter(_distance("q", "x") <= eps)
        .groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    )
    judged = checkpoint(
        counted.join(found, "key", "left")
        .withColumn("core", F.col("known") + F.coalesce("more", F.lit(0)) >= min_samples)
        .select("key", "x", "cell", "core"))

    # Core cells: crowded ones as they are, thin ones by their core points.
    core_cells = checkpoint(
        cells.filter(F.col("n") >= min_samples)
        .unionByName(judged.filter("core").groupBy("cell").agg(*_box(width)))
        .withColumn("crowded", F.col("n") >= min_samples))
    thin_core = judged.filter("core").select("key", "x", "cell")
    core_points = _core_points(points.filter(parts.is_hot()), cool, thin_core, thin_cells)
    edges = _core_edges(core_cells, near, core_points, parts, width, side, eps, direct_pairs)
    components = _components(core_cells.select(F.col("first_key").alias("node")), edges)

    roots = dense_codes(components.select(F.col("root").alias("key")).distinct(), "key", "label")
    numbered = components.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    named = lookup(
        components, "root", numbered.join(roots.withColumnRenamed("key", "root"), "root").select(
            F.col("root").alias("_root"), "label", "n"), "_root", "n").select("node", "label")
    cell_labels = checkpoint(core_cells.join(named, F.col("first_key") == F.col("node")).select(
        "cell", "label", "crowded", "n", "low", "high"))

    # Labels: crowded cells through their cell, core points of thin cells likewise, borders by reach.
    dense = cell_labels.filter("crowded").select(F.col("cell").alias("_cell"), "label", "n")
    by_cell = lookup(points, "cell", dense, "_cell", "n")
    in_crowded = by_cell.filter(F.col("label").isNotNull()).select("key", "x", "label")
    thin_labels = cell_labels.filter(~F.col("crowded")).select("cell", "label")
    in_thin = judged.filter("core").join(thin_labels, "cell").select("key", "x", "label")
    rest = judged.filter(~F.col("core")).select("key", "x", "cell")
    borders = _border_labels(rest, near, cell_labels, core_points, parts, eps)
    outer = rest.join(borders, "key", "left").select("key", "x", F.coalesce("label", F.lit(-1)).alias("label"))
    result = in_crowded.unionByName(in_thin).unionByName(outer)
    return result.select("key", "x", F.col("label").cast("bigint").alias("label"))


def _near_cells(cells: DataFrame, width: int, side: float, eps: float) -> DataFrame:
    """Ordered pairs of different cells whose boxes come within eps.

    Cells meet in blocks wider than eps, so a cell only visits the adjacent blocks.
    """
    span = math.ceil(eps / side)
    used = min(width, GRID_DIMENSIONS)
    block = F.transform(F.slice("cell", 1, used), lambda c: F.floor(c / F.lit(span)).cast("bigint"))
    home = cells.select("cell", "low", "high").withColumn("block", block)
    visiting = home.select(
        F.col("cell").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"), "block")
    for i in range(used):
        shifted = F.transform(
            F.col("block"), lambda v, j: F.when(j == i, v + F.col("_step")).otherwise(v))
        visiting = visiting.withColumn("_step", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)]))).withColumn(
            "block", shifted).drop("_step")
    return (
        home.join(visiting, "block")
        .filter((F.col("cell") != F.col("other")) & (_gap_low("low", "high", "other_low", "other_high") <= eps))
        .select("cell", "other")
    )


def _point_to_cells(points: DataFrame, near: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """For each point and near cell: the cell's size if all of it is in reach, or that it must be opened."""
    boxes = cells.select(F.col("cell").alias("other"), "n", "low", "high")
    meeting = (
        points.select("key", "x", "cell").join(near, "cell").join(boxes, "other")
        .filter(_gap_low("x", "x", "low", "high") <= eps)
    )
    inside = _gap_high("x", "x", "low", "high") <= eps
    return meeting.select(
        "key", "x", "other", F.when(inside, F.col("n")).otherwise(0).alias("whole"), (~inside).alias("partly"))


def _core_points(hot: DataFrame, cool: DataFrame, thin_core: DataFrame, thin_cells: DataFrame) -> DataFrame:
    """All core points: those of crowded cells and the core ones of thin cells.

    The points of hot cells take no part in the join that drops the thin cells.
    """
    crowded = cool.join(thin_cells.select("cell"), "cell", "left_anti")
    return hot.unionByName(crowded).select("key", "x", "cell").unionByName(thin_core)


def _core_edges(core_cells: DataFrame, near: DataFrame, core_points: DataFrame, parts: _Parts, width: int,
                side: float, eps: float, direct_pairs: int) -> DataFrame:
    """``(a, b)`` node pairs of core cells that hold core points within eps of each other."""
    left = core_cells.select(F.col("cell"), F.col("first_key").alias("a"), F.col("n").alias("n_a"),
                             F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    right = core_cells.select(F.col("cell").alias("other"), F.col("first_key").alias("b"), F.col("n").alias("n_b"),
                              F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = (
        near.join(left, "cell").join(right, "other").filter(F.col("a") < F.col("b"))
        .withColumn("sub_a", F.col("cell")).withColumn("sub_b", F.col("other"))
    )
    linked: list[DataFrame] = []
    level_side = side
    while True:
        low, high = _gap_low("low_a", "high_a", "low_b", "high_b"), _gap_high("low_a", "high_a", "low_b", "high_b")
        open_pairs = checkpoint(pairs.filter(low <= eps).withColumn("linked", high <= eps))
        linked.append(open_pairs.filter("linked").select("a", "b").distinct())
        unsettled = open_pairs.join(linked[-1], ["a", "b"], "left_anti")
        small = F.col("n_a") * F.col("n_b") <= direct_pairs
        linked.append(checkpoint(_direct_edges(
            unsettled.filter(small), core_points, parts, level_side if level_side != side else None, eps)))
        wide = unsettled.filter(~small).join(linked[-1], ["a", "b"], "left_anti")
        if wide.isEmpty():
            break
        parent_side, level_side = level_side, level_side / SPLIT
        boxes = (
            core_points.withColumn("parent", _grid(parent_side)).withColumn("sub", _grid(level_side))
            .groupBy("cell", "parent", "sub").agg(*_box(width))
        )
        mine = boxes.select(F.col("cell"), F.col("parent").alias("sub_a"), F.col("sub").alias("new_a"),
                            F.col("n").alias("n_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        theirs = boxes.select(F.col("cell").alias("other"), F.col("parent").alias("sub_b"),
                              F.col("sub").alias("new_b"), F.col("n").alias("n_b"), F.col("low").alias("low_b"),
                              F.col("high").alias("high_b"))
        pairs = (
            wide.select("a", "b", "cell", "other", "sub_a", "sub_b")
            .join(mine, ["cell", "sub_a"]).join(theirs, ["other", "sub_b"])
            .select("a", "b", "cell", "other", F.col("new_a").alias("sub_a"), F.col("new_b").alias("sub_b"),
                    "n_a", "n_b", "low_a", "high_a", "low_b", "high_b")
        )
    edges = linked[0]
    for more in linked[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def _direct_edges(pairs: DataFrame, core_points: DataFrame, parts: _Parts, level_side: float | None,
                  eps: float) -> DataFrame:
    """Compare the points of small box pairs; at most ``direct_pairs`` comparisons per pair."""
    sub = _grid(level_side) if level_side is not None else F.col("cell")
    marked = parts.points(core_points.withColumn("sub", sub)).select("cell", "sub", "part", "x")
    wanted = parts.visitors(pairs.select("a", "b", "cell", "other", "sub_a", "sub_b"), "cell")
    first = wanted.join(
        marked.select("cell", F.col("sub").alias("sub_a"), "part", F.col("x").alias("x_a")),
        ["cell", "sub_a", "part"]).drop("part")
    second = parts.visitors(first, "other").join(
        marked.select(F.col("cell").alias("other"), F.col("sub").alias("sub_b"), "part", F.col("x").alias("x_b")),
        ["other", "sub_b", "part"])
    return second.filter(_distance("x_a", "x_b") <= eps).select("a", "b").distinct()


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node each node is connected to.

    FastSV (Zhang, Azad and Hu, 2020): in every round a node and its parent both
    hook to the smallest grandparent among the node's neighbours, and then every
    node moves up to its grandparent. Minima are combined before each shuffle,
    and parents shared by very many nodes are looked up apart.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = checkpoint(nodes.select("node", F.col("node").alias("parent"), F.col("node").alias("grand")))
    while True:
        offers = both.join(state.select("node", "grand"), F.col("a") == F.col("node")).groupBy("b").agg(
            F.min("grand").alias("offer"))
        offered = state.join(offers, F.col("node") == F.col("b"), "left").select(
            "node", "parent", "grand", F.coalesce("offer", "grand").alias("offer"))
        hooked = offered.groupBy("parent").agg(F.min("offer").alias("hook_offer")).select(
            F.col("parent").alias("hook"), "hook_offer")
        moved = checkpoint(offered.join(hooked, F.col("node") == F.col("hook"), "left").select(
            "node", F.least("parent", "grand", "offer", F.coalesce("hook_offer", "grand")).alias("parent"),
            F.col("grand").alias("before")))
        shared = moved.groupBy(F.col("parent").alias("_parent")).agg(F.count(F.lit(1)).alias("n"))
        ancestors = shared.join(
            moved.select(F.col("node").alias("_parent"), F.col("parent").alias("grand")), "_parent")
        jumped = checkpoint(lookup(moved, "parent", ancestors, "_parent", "n"))
        state = jumped.select("node", "parent", "grand")
        if jumped.filter(F.col("grand") != F.col("before")).isEmpty():
            return state.select("node", F.col("grand").alias("root"))


def _border_labels(rest: DataFrame, near: DataFrame, cell_labels: DataFrame, core_points: DataFrame, parts: _Parts,
                   eps: float) -> DataFrame:
    """The lowest cluster label with a core point within eps of each non-core point."""
    # A core point of the own cell is always in reach.
    own = rest.select("key", "cell").join(cell_labels.select("cell", "label"), "cell").select("key", "label")
    boxes = cell_labels.select(F.col("cell").alias("other"), "label", "low", "high")
    meeting = (
        rest.join(near, "cell").join(boxes, "other").filter(_gap_low("x", "x", "low", "high") <= eps)
        .withColumn("inside", _gap_high("x", "x", "low", "high") <= eps)
    )
    covered = meeting.filter("inside").select("key", "label")
    visits = parts.visitors(
        meeting.filter(~F.col("inside")).select("key", F.col("x").alias("q"), F.col("other").alias("cell"), "label"),
        "cell")
    dealt = parts.points(core_points).select("cell", "part", "x")
    reached = (
        visits.join(dealt, ["cell", "part"]).filter(_distance("q", "x") <= eps).select("key", "label"))
    return own.unionByName(covered).unionByName(reached).groupBy("key").agg(F.min("label").alias("label"))
