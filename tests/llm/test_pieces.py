"""Ids and digests of whole batches are those of the library, text by text."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from veritab.llm import pieces


def test_digests_of_odd_texts():
    library = pieces.encoder(pieces.model_path()).library
    texts = ["", "a", " ", "  two  spaces ", "plain words here", "▁ mark▁ed", "日本語 и кириллица", "\U0001f600\U0001f601 x", "w" * 200,
             "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "tab\tline\nfeed\r\n", "͸͹ unknown", None, "plain words here"]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    found = [r for b in pieces._digests(iter([batch]), pieces.model_path()) for r in b.to_pylist()]
    for text, row in zip(texts, found, strict=True):
        ids = library.encode(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest()


def test_decimals_of_any_size():
    for ids in ([], [0], [7, 10, 99, 100, 0, 31999], [70_000, 3]):
        assert pieces._decimals(np.array(ids, np.int64)) == ",".join(map(str, ids)).encode()


def test_difference_from_the_library_ends_the_job():
    tool = pieces.PieceEncoder(pieces.model_path())
    words = [pieces.SPACE + w for w in ("some", "words", "here")] + ["inner"]
    ids, ends = tool._agendas(words)
    tool._check(words, ids, ends)
    for other in (np.append(ids[:2], ids[2:] + 1), np.where(np.arange(len(ids)) == 0, 5, ids)):
        with pytest.raises(ValueError, match="differs from the library"):
            tool._check(words, other, ends)
