"""Merkle manifest of a table: a proof for every row, by a butterfly exchange between blocks of leaves.

Every row is a leaf, and the leaves of one tree (a language, say) stand in one
order. They are dealt into aligned blocks of ``fanout ** height`` leaves, and
each block hashes its own subtree. Then the blocks swap subtree roots in rounds:
in round ``r`` the ``fanout`` neighbouring subtrees of ``fanout ** r`` blocks make
one run, and every block gets the roots of the other subtrees of its run from
one block in each of them, namely the one at its own place there. All blocks of
a run hash the common ancestor, redundantly, so after the last round each block
holds the root and the upper part of all its proofs, and nothing has to be
passed down again. A subtree at the end with fewer blocks answers several
askers from each of them. The roots of the trees then make one more tree in the
same way, whose blocks hold one root each.

A node is the lowercase hexadecimal SHA-256 of its children's digests as text.
While a level has several nodes, each run of ``fanout`` consecutive ones, also a
shorter one at the end, becomes one node above.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.llm.base import Scratch, query, table

BLOCK_LEAVES = 4096
RANGE_ROWS = 200_000
PROOF = "array<struct<before: string, after: string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields in order, each as UTF-8 byte count, colon and value, or ``-`` if NULL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, from the leaf's level to the root's, left to right, as one text."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"])))


def merkle_manifest(
    rows: DataFrame,
    leaf: Column,
    tree: Column,
    order: Sequence[Column],
    carry: Mapping[str, Column],
    fanout: int = 2,
    block_leaves: int = BLOCK_LEAVES,
) -> DataFrame:
    """``carry..., leaf, subroot, root, proof`` for every row.

    ``leaf`` is each row's digest, ``tree`` the text that names its tree (NULL is a
    tree of its own and comes first), ``order`` what its leaves ascend by, NULL
    first. Rows that ``order`` does not tell apart follow by their digest, so equal
    rows are leaves side by side and the result does not depend on how the table
    was read. ``proof`` holds for each level, from the leaf up, the digests to the
    left and to the right within the run; a tree of one leaf adds no level. Only
    the given expressions are read, whatever other columns there are. An empty
    table has no rows in its manifest.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    scratch = Scratch(rows.sparkSession)
    height = max(1, math.floor(math.log(block_leaves, fanout) + 1e-9))
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("")).alias("tree"),
        F.struct(*order).alias("order"), leaf.alias("leaf"),
        F.struct(*[c.alias(name) for name, c in carry.items()]).alias("carried"))

    def block_root(block: pa.Table) -> pa.Table:
        return _block_root(block, fanout, height)

    def proofs(block: pa.Table, paths: pa.Table) -> pa.Table:
        return _proofs(block, paths, fanout, height)

    placed = _placed(scratch, leaves, ["order", "leaf"])
    placed = scratch.write(placed.withColumn("block", F.floor(F.col("place") / F.lit(fanout ** height)).cast("long")))
    blocks = scratch.write(placed.select("tree", "block", "place", "leaf", "leaves").groupBy("tree", "block").applyInArrow(
        block_root, "tree string, block long, blocks long, digest string"))
    lower = _exchanged(scratch, blocks, fanout)

    subroots = lower.filter("block = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    ranked = _placed(scratch, subroots, ["name"]).select(
        "tree", F.col("place").alias("block"), F.col("leaves").alias("blocks"), F.col("subroot").alias("digest"), "name",
        "subroot")
    upper = _exchanged(scratch, scratch.write(ranked), fanout)

    paths = scratch.write(lower.select("tree", "block", "path").join(
        upper.select(F.col("name").alias("tree"), "subroot", F.col("digest").alias("root"), F.col("path").alias("rest")),
        "tree").select("tree", "block", "subroot", "root", F.concat("path", "rest").alias("path")))
    carried = placed.schema["carried"].dataType.simpleString()
    proven = placed.drop("order").groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(
        proofs, f"carried {carried}, leaf string, subroot string, root string, proof {PROOF}")
    return proven.select("carried.*", "leaf", "subroot", "root", "proof")


def _placed(scratch: Scratch, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``place``, from 0 in each tree, and ``leaves``, the number of rows of the tree.

    Rows are dealt into ranges of the whole order, so a tree that holds most rows
    covers many of them; the counts of the earlier ranges are added to the place
    within a range.
    """
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    dealt = scratch.write(rows.repartitionByRange(ranges, "tree", *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("held"))
    along = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "range", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("start"),
        F.sum("held").over(Window.partitionBy("tree")).alias("leaves"))
    within = Window.partitionBy("tree", "range").orderBy(*order)
    return dealt.withColumn("at", F.row_number().over(within)).join(starts, ["tree", "range"]).withColumn(
        "place", F.col("start") + F.col("at") - 1).drop("range", "start", "at")


def _node(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(leaves: list[str], leaves_of_tree: int, fanout: int, height: int) -> list[list[str]]:
    """The nodes of a block, level by level, up to ``height`` levels or the root of the tree."""
    levels, left = [leaves], leaves_of_tree
    while left > 1 and len(levels) <= height:
        below = levels[-1]
        levels.append([_node(below[i:i + fanout]) for i in range(0, len(below), fanout)])
        left = -(-left // fanout)
    return levels


def _block_root(block: pa.Table, fanout: int, height: int) -> pa.Table:
    block = block.sort_by("place")
    leaves = block["leaves"][0].as_py()
    top = _levels(block["leaf"].to_pylist(), leaves, fanout, height)[-1]
    return pa.table({
        "tree": block["tree"].slice(0, 1), "block": block["block"].slice(0, 1),
        "blocks": pa.array([-(-leaves // fanout ** height)], pa.int64()), "digest": pa.array(top, pa.string()),
    })


def _exchanged(scratch: Scratch, blocks: DataFrame, fanout: int) -> DataFrame:
    """The blocks with their tree's root as ``digest`` and the siblings on the way there as ``path``.

    Every round is written before the next, so a lost executor repeats one round at most.
    """
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    state = blocks.withColumn("path", F.array().cast(PROOF))
    reach = 1
    while reach < most:
        above = scratch.write(_round(state, reach, fanout))
        if reach > 1:
            scratch.drop(state)
        state, reach = above, reach * fanout
    return state


def _round(state: DataFrame, reach: int, fanout: int) -> DataFrame:
    """One exchange between runs of ``fanout`` subtrees of ``reach`` blocks."""
    own = F.floor(F.col("block") / F.lit(reach)).cast("long")
    first = own - own % fanout
    last = F.least(first + fanout, F.ceil(F.col("blocks") / F.lit(reach)).cast("long")) - 1
    active = F.col("blocks") > reach
    others = F.filter(F.sequence(first, last), lambda s: s != own)
    partners = F.transform(others, lambda s: F.struct(s.alias("subtree"), (
        s * reach + (F.col("block") % reach) % F.least(F.lit(reach).cast("long"), F.col("blocks") - s * reach)
    ).alias("partner")))
    asked = state.filter(active).select("tree", "block", F.explode(partners).alias("ask")).select(
        "tree", F.col("block").alias("asker"), "ask.subtree", F.col("ask.partner").alias("block"))
    answers = asked.join(state.select("tree", "block", "digest"), ["tree", "block"]).groupBy(
        "tree", F.col("asker").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("subtree", "digest"))).alias("answers"))

    def side(keep) -> Column:
        return F.concat_ws("", F.transform(F.filter("answers", keep), lambda a: a["digest"]))

    joined = state.join(answers, ["tree", "block"], "left").withColumn("answers", F.coalesce(
        "answers", F.array().cast("array<struct<subtree: bigint, digest: string>>")))
    level = F.struct(side(lambda a: a["subtree"] < own).alias("before"), side(lambda a: a["subtree"] > own).alias("after"))
    return joined.withColumn("level", level).select(
        *[c for c in state.columns if c not in ("digest", "path")],
        F.when(active, F.sha2(F.concat("level.before", "digest", "level.after"), 256)).otherwise(
            F.col("digest")).alias("digest"),
        F.when(active, F.concat("path", F.array("level"))).otherwise(F.col("path")).cast(PROOF).alias("path"))


def _proofs(block: pa.Table, paths: pa.Table, fanout: int, height: int) -> pa.Table:
    block = block.sort_by("place")
    levels = _levels(block["leaf"].to_pylist(), block["leaves"][0].as_py(), fanout, height)
    rest = paths["path"][0].as_py()
    proofs = []
    for place in range(block.num_rows):
        proof, at = [], place
        for nodes in levels[:-1]:
            first = at - at % fanout
            proof.append({"before": "".join(nodes[first:at]), "after": "".join(nodes[at + 1:first + fanout])})
            at //= fanout
        proofs.append(proof + rest)
    same = [0] * block.num_rows
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({
        "carried": block["carried"], "leaf": block["leaf"], "subroot": paths["subroot"].take(same),
        "root": paths["root"].take(same), "proof": pa.array(proofs, kind),
    })


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda s, _: xor(s >> 1, 3988292384::BIGINT * (s & 1))))"""
_FIELD = "coalesce(strlen({x}) || ':' || {x}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(x=x) for x in (
        "doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN xor({_CRC.format(x="doc_id::VARCHAR")}, 4294967295) % 7 = 0 THEN {_leaf_sql("n_chars + 1")}
      ELSE {_leaf_sql("n_chars")} END AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place,
        count(*) OVER (PARTITION BY tree) AS n FROM d),
low(tree, level, place, digest, n) AS (
  SELECT tree, 0, place, leaf, n FROM p
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY tree, level, place // 2, n),
s AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS rank,
        count(*) OVER () AS trees FROM low WHERE n = 1),
high(level, place, digest, n) AS (
  SELECT 0, rank, subroot, trees FROM s
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, place // 2, n),
steps AS (
  SELECT p.tree, p.place, l.level, CASE WHEN (p.place >> l.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(o.digest, '') AS step
  FROM p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) l USING (tree)
  LEFT JOIN low o ON o.tree = p.tree AND o.level = l.level AND o.place = xor(p.place >> l.level, 1)
  UNION ALL
  SELECT p.tree, p.place, s.height + l.level,
    CASE WHEN (s.rank >> l.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(o.digest, '')
  FROM p JOIN s USING (tree) CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) l
  LEFT JOIN high o ON o.level = l.level AND o.place = xor(s.rank >> l.level, 1)),
q AS (SELECT tree, place, list(step ORDER BY level) AS steps FROM steps GROUP BY tree, place),
f AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM high WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(q.steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(p.claimed, coalesce(q.steps, [])),
      lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM p JOIN s USING (tree) LEFT JOIN q ON q.tree = p.tree AND q.place = p.place)
SELECT *, folded_root = root AS verified FROM f
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def _merkle_manifest(spark, folder):
    return checked_manifest(table(spark, folder, "documents"))


def checked_manifest(documents: DataFrame, fanout: int = 2, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``documents``.

    Leaves are the digests of ``doc_id, source, lang, n_chars, text``; each language
    is a tree that ascends by ``doc_id``. Every row is verified against its proof;
    where 7 divides the CRC-32 of the id, the row is tampered with first: one is
    added to ``n_chars`` (a NULL stays). Rows without an id are never tampered with.
    """
    def digest(n_chars: Column) -> Column:
        return leaf_digest(*[documents[c] for c in ("doc_id", "source", "lang")], n_chars, documents["text"])

    original = digest(documents["n_chars"])
    claimed = F.when(F.crc32(documents["doc_id"].cast("string")) % 7 == 0, digest(documents["n_chars"] + 1)).otherwise(
        original)
    proven = merkle_manifest(documents, original, documents["lang"], [documents["doc_id"]],
                             {"doc_id": documents["doc_id"], "claimed": claimed}, fanout, block_leaves)
    return proven.withColumn("folded_root", folded(F.col("claimed"), F.col("proof"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
