"""The Merkle manifest against a plain computation of the whole tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veritab.llm.manifest import checked_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root, and for each node the siblings to the left and right, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % fanout
            proofs[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1:first + fanout])))
            at[i] = place // fanout
        nodes = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    climbed = {n: climb([leaf(r) for r in trees[n]], fanout) for n in names}
    root, upper = climb([climbed[n][0] for n in names], fanout)
    out = []
    for n, rest in zip(names, upper):
        for row, proof in zip(trees[n], climbed[n][1]):
            proof = proof + rest
            digest = leaf(row, 1 if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else 0)
            for before, after in proof:
                digest = H(before + digest + after)
            out.append((row[0], leaf(row), climbed[n][0], root, H("".join(a + b for a, b in proof)), digest, digest == root))
    return sorted(out, key=repr)


def rows_of(sizes):
    rows = []
    for lang, n in sizes.items():
        for i in range(n):
            k = len(rows)
            rows.append((k * 7919 % 100_003, None if k % 5 == 0 else f"s{k % 3}", lang, None if k % 4 == 0 else k,
                         None if k % 11 == 0 else "é" * (k % 6)))
    return rows


@pytest.mark.parametrize("fanout,block,sizes", [
    (2, 4, {"en": 150, None: 7, "fr": 1, "": 2, "z": 33}),
    (3, 9, {"en": 100, "de": 28, None: 1}),
    (5, 5, {"en": 126, "ü": 6}),
    (2, 2, {"en": 17}),
    (2, 4096, {"en": 1}),
])
def test_manifest_is_the_whole_tree(spark, fanout, block, sizes):
    rows = rows_of(sizes)
    got = checked_manifest(spark.createDataFrame(rows, SCHEMA), fanout, block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, fanout)
    assert all(r["verified"] or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in got)


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(1, "s", "en", 3, "abc")] * 3 + [(None, None, None, None, None)] * 2 + [
        (1, "s", "en", 3, "other"), (2, "s", "en", 10 ** 6, "x" * 10 ** 6), (0, "", "", 0, "")]
    got = checked_manifest(spark.createDataFrame(rows, SCHEMA), 2, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_empty_table(spark):
    assert checked_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_columns_with_clashing_names(spark):
    rows = rows_of({"en": 9, "de": 4})
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "order", "leaf", "carried", "block", "place", "leaves", "root", "path", "claimed", "proof"):
        frame = frame.withColumn(name, F.lit("x"))
    got = checked_manifest(frame, 2, 4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_fanout_must_branch(spark):
    with pytest.raises(ValueError):
        checked_manifest(spark.createDataFrame([], SCHEMA), 1)
