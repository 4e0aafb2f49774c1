"""Phrase mining against plain counting, with budgets and dictionaries small enough to split everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, max_words=3, least=10, cover=50, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i:i + size])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), f in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * f >= cover * counts[lang, p[i:i + size]]:
                    covered.add((lang, p[i:i + size]))
    scored = {}
    for (lang, p), a in found.items():
        if (lang, p) in covered:
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored.setdefault(lang, []).append(
            (-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out = []
    for lang, items in scored.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(items)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(n, seed, words=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "New", "YORK", "日本", "x" * 40] + [f"w{i}" for i in range(words)]
    weights = [30, 20, 6, 8, 8, 4, 3] + [200 / (i + 3) for i in range(words)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(80)):
            out.append(rng.choices(vocabulary, weights)[0])
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]))
            if rng.random() < 0.05:
                out.append("hot dog stand ")
        rows.append((i, "".join(out), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("budget,dictionary,max_words,least,top", [
    (1 << 21, 1 << 21, 3, 10, 2000), (16, 1 << 21, 3, 10, 2000), (200, 5, 3, 4, 20), (64, 0, 4, 5, None), (8, 30, 2, 1, 50),
])
def test_counts_are_those_of_plain_counting(spark, budget, dictionary, max_words, least, top):
    rows = texts(150, 3)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), max_words, least, 50, top, budget,
                               dictionary).collect()
    assert sorted(map(tuple, got)) == brute(rows, max_words, least, 50, top or 10 ** 9)


def test_hot_phrase_in_a_third_of_all_rows(spark):
    rows = texts(60, 4) + [(i, "same words here " * 200, "en") for i in range(100, 130)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), budget=300).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " .,; \n", "en"), (None, "a b " * 3000, "en"), (4, "A B", "und"),
            (4, "a b " * 30, None), (4, "a b " * 30, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(1) for c in ("code", "word", "words", "f", "group", "n", "a", "l", "r", "score", "rank", "first", "low")})
    assert sorted(map(tuple, phrases.collocations(frame).collect())) == brute(rows)
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame(rows[:3], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(frame, max_words=1)


def test_other_hashes_are_taken_when_two_words_share_one(spark, monkeypatch):
    rows, salts, counted = texts(40, 5), [], phrases._counted

    def clashing(scratch, frame, salt):
        salts.append(salt)
        found = counted(scratch, frame, salt)
        return found if salt else scratch.write(found.withColumn("clash", F.lit(True)))

    monkeypatch.setattr(phrases, "_counted", clashing)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, least=3) and salts == [0, 1]


def test_heavy_words_extend_the_prefix():
    columns = [np.array(c, np.uint32) for c in ([1, 1, 1, 5, 5], [1, 7, 7, 1, 2], [3, 3, 4, 0, 0])]
    group = phrases._group(columns, 2, 1 << 40)
    assert group[1] == group[2] and group[3] == group[4] and len(set(group.tolist())) == 3
