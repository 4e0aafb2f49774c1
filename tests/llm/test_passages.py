"""Every exactly repeated run of 50 words is covered, whatever its seeds did before; fuzzy copies are measured."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veritab.llm import passages
from veritab.llm.words import shingle_hashes, word_hashes


def found_spans(spark, rows, **options):
    spans = {}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in passages.repeated_passages(frame, **options).collect():
        spans.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"]))
    return spans


def uncovered(rows, spans, least=50):
    """Places of runs that an earlier document holds and no passage covers; and how many there are at all."""
    seen, lost, total = {}, [], 0
    for doc, text in sorted(rows):
        words = text.split()
        for at in range(len(words) - least + 1):
            run = tuple(words[at:at + least])
            if seen.setdefault(run, doc) != doc:
                total += 1
                if not any(a <= at and at + least - 1 <= b for a, b in spans.get(doc, [])):
                    lost.append((doc, at))
    return lost, total


@pytest.mark.parametrize("seed,sizes", [(1, (8, 30)), (2, (20, 70)), (3, (45, 120)), (4, (3, 12))])
def test_all_exact_repeats_of_texts_made_of_pieces(spark, seed, sizes):
    rng = random.Random(seed)
    pieces = [[f"p{i}w{rng.randrange(60)}" for _ in range(rng.randint(*sizes))] for i in range(25)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randint(2, 12)):
            if rng.random() < 0.8:
                first = rng.randrange(len(pieces))
                words += sum(pieces[first:first + rng.choice([1, 1, 2, 8])], [])
            else:
                words += [f"u{rng.randrange(10 ** 6)}" for _ in range(20)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((doc, " ".join(words)))
    lost, total = uncovered(rows, found_spans(spark, rows))
    assert total > 100 and not lost


def test_seeds_that_first_occur_in_line_but_far_from_the_run(spark):
    rng = random.Random(9)
    passage = [f"a{rng.randrange(10 ** 6)}" for _ in range(50)]
    noise = [[f"n{rng.randrange(10 ** 6)}" for _ in range(30)] for _ in range(9)]
    rows = [(1, " ".join(noise[0] + passage[:25] + noise[1])), (2, " ".join(noise[2] + passage[25:] + noise[3])),
            (3, " ".join(noise[4] + passage + noise[5])), (4, " ".join(noise[6] + passage + noise[7]))]
    assert uncovered(rows, found_spans(spark, rows)) == ([], 1)


def test_changed_copies_of_one_passage(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for k in range(80):
        passage = [f"k{k}w{rng.randrange(10 ** 4)}" for _ in range(rng.randint(70, 200))]
        copy = [w if rng.random() > 0.08 else f"x{rng.randrange(10 ** 6)}" for w in passage]
        for doc, words in ((2 * k, passage), (2 * k + 1, copy)):
            before = [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40))]
            rows.append((doc, " ".join(before + words + [f"u{rng.randrange(10 ** 6)}" for _ in range(30)])))
            planted.append((doc, len(before), len(before) + len(words) - 1))
    spans = found_spans(spark, rows)
    caught = [sum(min(b, last) - max(a, first) + 1 for a, b in spans.get(doc, []) if a <= last and b >= first)
              >= 0.8 * (last - first + 1) for doc, first, last in planted if doc % 2]
    assert sum(caught) >= 0.9 * len(caught)


def test_periodic_text_is_one_passage(spark):
    rng = random.Random(11)
    texts = {}
    for doc, (period, times) in enumerate([(2, 300), (2, 300), (2, 200), (2, 700), (3, 150), (3, 150), (60, 6), (60, 6)]):
        own = [f"o{rng.randrange(10 ** 6)}" for _ in range(40)]
        texts[doc] = own + [f"p{period}w{i}" for i in range(period)] * times + own[::-1]
    rows = [(doc, " ".join(words)) for doc, words in texts.items()]
    spans = found_spans(spark, rows)
    lost, total = uncovered(rows, spans)
    assert total > 2000 and not lost
    # Longer periods, and those longer than the earlier text, begin anew; before, nearly every word began a passage.
    counts = {doc: len(s) for doc, s in spans.items()}
    assert (counts[1], counts[2], counts[5]) == (1, 1, 1) and counts[3] <= 3 and counts[7] <= 7


def test_rows_of_a_common_line_do_not_grow_with_its_times(spark, monkeypatch):
    rng = random.Random(13)
    matched, aligned = [], passages._aligned

    def counted(scratch, source, matches, *options):
        matched.append(matches.count())
        return aligned(scratch, source, matches, *options)

    def own():
        return [f"o{rng.randrange(10 ** 9)}" for _ in range(30)]

    monkeypatch.setattr(passages, "_aligned", counted)
    line = [f"l{i}" for i in range(9)]
    rows = [(doc, " ".join(own() + line * rng.randint(90, 110) + own())) for doc in range(12)]
    lost, total = uncovered(rows, found_spans(spark, rows))
    assert total > 8000 and not lost
    # A row for each time, about 1100 in either pass, before.
    assert len(matched) == 2 and max(matched) <= 12 * 6


def test_series_hold_every_place_of_the_seeds():
    rng = random.Random(17)
    texts = ["", None, "a b", " ".join(["x y z"] * 70), " ".join(f"r{rng.randrange(10 ** 6)}" for _ in range(120))]
    for _ in range(40):
        lines = [[f"w{rng.randrange(6)}" for _ in range(rng.randint(1, 25))] for _ in range(3)]
        texts.append(" ".join(sum((rng.choice(lines) for _ in range(rng.randint(1, 40))), [])))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    found, series = [], 0
    for rows in passages._seeds(iter([batch]), 50):
        series += rows.num_rows
        place, seed, doc_id = passages._every_place(*(rows.column(c).to_numpy() for c in (
            "place", "step", "times", "seed", "doc_id")))
        found += zip(doc_id.tolist(), place.tolist(), seed.tolist())
    wanted = []
    for doc, text in enumerate(texts):
        _, hashes = word_hashes(pa.array([text], pa.string()))
        if len(hashes) >= 50:
            grams = shingle_hashes(hashes, passages.SEED)
            wanted += [(doc, at, grams.view(np.int64)[at].item()) for at in passages.winnowed(grams).tolist()]
    assert sorted(found) == sorted(wanted) and series < len(wanted)


def test_gap_of_any_size_is_aligned():
    rng = random.Random(3)
    words = [rng.randrange(10 ** 6) for _ in range(1600)]
    a = np.array(words, np.uint32)
    b = np.array(words[:100] + [1] + words[100:1400] + [2] + words[1400:], np.uint32)
    # The words of the gap but two are equal: one passage, where a table of 1300 x 1301 cells was too large before.
    found = passages.aligned_passages(a, b, [0, 1590], [0, 1592], 50, 80)
    assert found == [(0, 1599, 0, 1601, 1600)]


def test_long_gaps_have_longest_common_subsequences(monkeypatch):
    def halved(a, b):
        if len(a) * len(b) > 1:
            return passages._long_gap(a, b)
        return ([0], [0]) if len(a) and len(b) and a[0] == b[0] else ([], [])

    monkeypatch.setattr(passages, "MAX_GAP_CELLS", 1)
    monkeypatch.setattr(passages, "_gap", halved)
    rng = random.Random(8)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(1, 30))], np.uint32) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        left, right = passages._long_gap(a, b)
        assert left == sorted(set(left)) and right == sorted(set(right)) and (a[left] == b[right]).all()
        assert len(left) == table[-1][-1]
