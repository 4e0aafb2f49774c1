"""Workers hold little of a batch at a time, and what they hold does not show in the results."""

import numpy as np
import pyarrow as pa
import pytest

from veritab.llm import near_dedup, passages, words


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    return pa.record_batch({"doc_id": pa.array(range(40), pa.int64()),
                            "text": [" ".join(f"w{i}" for i in rng.integers(0, 5000, 33_000)) for _ in range(40)]})


def test_large_batches_are_worked_on_in_parts(texts):
    size = texts.column("text").nbytes
    assert size > 6 << 20
    for parts in (near_dedup._sign(iter([texts]), 5), passages._seeds(iter([texts]), 50), passages._blocks(iter([texts]))):
        assert len(list(parts)) >= size // (2 << 20)


def test_hashes_do_not_depend_on_segments(texts, monkeypatch):
    few = texts.slice(0, 3).column("text")
    want = words.word_hashes(few)
    monkeypatch.setattr(words, "SEGMENT_BYTES", 1 << 12)
    assert all(np.array_equal(a, b) for a, b in zip(words.word_hashes(few), want))


def test_long_hashes_are_made_once_for_a_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(passages, "shingles_at", lambda *args: calls.append(args) or words.shingles_at(*args))
    batch = pa.record_batch({"doc_id": pa.array(range(50), pa.int64()),
                             "text": [" ".join(f"d{d}w{i}" for i in range(60 + d)) for d in range(50)]})
    list(passages._seeds(iter([batch]), 50))
    assert len(calls) == 1


def test_groups_that_span_batches_stay_whole():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 6]
    batch = pa.record_batch({"key": pa.array(keys, pa.int64()), "at": pa.array(range(len(keys)), pa.int64())})
    for size in (1, 2, 3, 5, 12):
        found = []
        for part, cuts in words.whole_groups((batch.slice(i, size) for i in range(0, len(keys), size)), ["key"]):
            found += [part.column("at")[a:b].to_pylist() for a, b in zip(cuts, cuts[1:])]
        assert found == [[0, 1], [2], [3, 4, 5, 6, 7], [8], [9, 10], [11]]
