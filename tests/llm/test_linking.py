"""Families around the threshold are linked exactly, in as few rounds as their pairs allow."""

import random

from veritab.llm import linking, near_dedup


def family(rng, n, size, least, most):
    """Texts that differ from one base text in some words each; similarities lie on both sides of the threshold."""
    base = [f"w{i}" for i in range(size)]
    rows = []
    for doc in range(n):
        words = list(base)
        for i in rng.sample(range(size), rng.randint(least, most)):
            words[i] = f"x{rng.randrange(10 ** 6)}"
        rows.append((doc, " ".join(words)))
    return rows


def brute_force(rows, percent=80):
    sets = [{tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in (text.split() for _, text in rows)]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(a) for a in range(len(rows))]


def test_a_family_around_the_threshold_takes_one_round(spark, monkeypatch):
    rounds = []
    offered = linking._offered
    monkeypatch.setattr(linking, "_offered", lambda *args: rounds.append(args) or offered(*args))
    rows = family(random.Random(4), 160, 150, 6, 13)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[d] for d, _ in rows] == brute_force(rows)
    assert len(rounds) == 1


def test_forests_of_many_pairs_end_with_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(linking, "FIRST_FORESTS", 1)
    rows = family(random.Random(6), 120, 150, 9, 13)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[d] for d, _ in rows] == brute_force(rows)
