"""The Jaccard join and the linking of groups against plain comparison of all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import jaccard_join, linking
from veritab.llm.base import Scratch
from veritab.llm.linking import components
from veritab.llm.words import mix

SCHEMA = "doc_id long, text string"


def shingles(text, size=4):
    words = (text or "").lower().split()
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size=4, percent=85):
    """Expected rows; ids may repeat."""
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t, size)), None if i is None else top(i)) for i, t in rows), key=repr)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, jaccard_join.jaccard_components(frame, **options).collect()), key=repr)


def family(rng, n, words, changes, start):
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(words)] = f"z{rng.randrange(40)}"
        rows.append((start + i, " ".join(own)))
    return rows


def test_families_common_phrases_and_copies(spark):
    rng = random.Random(1)
    rows = family(rng, 60, 120, 6, 0) + family(rng, 80, 300, 14, 100) + family(rng, 50, 30, 2, 300)
    rows += [(400 + i, "exactly the same text in a third of all rows") for i in range(90)]
    phrase = " ".join(f"p{i}" for i in range(60))
    rows += [(600 + i, phrase + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4, 30))))
             for i in range(80)]
    assert got(spark, rows) == brute(rows)
    # A table too small for all tokens leaves them rare, and so do shared slots; neither changes the result.
    assert got(spark, rows, most=50) == brute(rows)
    # Nearly all shared tokens in pairs or triples.
    assert got(spark, rows, frequency=(2, 5)) == brute(rows)


@pytest.mark.parametrize("shingle,percent", [(1, 80), (2, 60), (4, 100), (3, 50)])
def test_other_thresholds(spark, shingle, percent):
    rng = random.Random(shingle)
    rows = family(rng, 30, 70, 12, 0) + [
        (100 + i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(9)))) for i in range(60)]
    assert got(spark, rows, shingle=shingle, percent=percent) == brute(rows, shingle, percent)


def test_combinations_of_frequent_tokens_meet(monkeypatch):
    """Any two sets of tokens of all classes that are alike enough share a combination, alone, by two or by three."""
    rng = np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.choice([3, 8, 40, 63, 64, 70, 90, 130, 400]))
        percent = int(rng.choice([60, 80, 85, 95]))
        tokens = mix(np.arange(3 * n, dtype=np.uint64) + np.uint64(trial * 10 ** 6))
        levels = rng.choice(np.array([0, 2, 4, 6, 12, 16, 20], np.uint8), 3 * n,
                            p=rng.dirichlet(np.full(7, 0.4)))
        a = np.arange(n)
        lost = rng.permutation(n)[:int(rng.integers(0, n + 1))]
        b = np.setdiff1d(a, lost)
        b = np.append(b, n + np.arange(int(rng.integers(0, n // 3 + 1))))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        made = [jaccard_join.combinations(np.sort(tokens[x]), levels[x][np.argsort(tokens[x])], percent, False)
                for x in (a, b)]
        assert len(np.intersect1d(*made))


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for sizes in ((5, 9), (64, 65), (300, 340), (1000, 2100)):
        common = mix(np.arange(min(sizes) // 2, dtype=np.uint64))
        sets = [np.concatenate((common, rng.integers(0, 2 ** 63, n - len(common)).astype(np.uint64))) for n in sizes]
        bits = [np.frombuffer(linking.parity_bits(s), np.uint64) for s in sets]
        differ = linking.unlike_places(bits[0], bits[1][None])[0]
        assert differ <= len(np.setxor1d(*sets)) and differ == linking.unlike_places(bits[1], bits[0][None])[0]
        assert linking.unlike_places(bits[0], bits[0][None])[0] == 0


def test_family_below_the_threshold_offers_few_pairs(spark, monkeypatch):
    """Members alike to 0.8 but not 0.85 are no links, and all their pairs are never offered."""
    monkeypatch.setattr(linking, "BLOCK_MEMBERS", 16)
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2 ** 62, 800).astype(np.uint64)
    rows = []
    for i in range(100):
        own = rng.integers(0, 2 ** 62, 100).astype(np.uint64)
        rows.append((i, np.sort(np.concatenate((common, own)))))
    for i in range(100, 110):
        rows.append((i, np.sort(np.concatenate((rows[i - 100][1][:-20], rng.integers(0, 2 ** 62, 20).astype(np.uint64))))))
    sets = spark.createDataFrame([(i, len(s), linking.parity_bits(s), s.tobytes()) for i, s in rows],
                                 "rep long, n long, bits binary, elements binary")
    members = spark.createDataFrame([(k, i) for i, _ in rows for k in range(3)], "key long, rep long")
    judged, plain = [], linking._judged

    def counting(pairs, frame, percent):
        judged.append(pairs.count())
        return plain(pairs, frame, percent)

    monkeypatch.setattr(linking, "_judged", counting)
    scratch = Scratch(spark)
    found = {tuple(r) for r in components(scratch, linking.links(scratch, members, sets, 85)).collect()}
    assert found == {(i, i % 100) for i in [*range(10), *range(100, 110)]}
    assert sum(judged) < 400


def test_edges(spark):
    long = "a b c d e f g " * 30000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, None),
            (7, long), (7, long), (8, long + "x"), (9, "日本 ünï 🎉"), (10, "日本 ünï 🎉"), (10, "one two"), (11, "One Two")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:3]) == brute(rows[:3])
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in (
        "n", "rep", "key", "digest", "root", "node", "size", "bits", "elements", "a", "b", "range", "slots", "shared")})
    assert sorted(map(tuple, jaccard_join.jaccard_components(frame).collect()), key=repr) == brute(rows)
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(frame, percent=40)
