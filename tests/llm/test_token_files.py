"""Whole texts are cut into the tokenizer's own parts, and each distinct part is encoded once."""

import random

import pytest

from veritab.llm import token_files


@pytest.fixture()
def tool():
    return token_files.CachedTokenizer(token_files.tokenizer_path())


def test_each_distinct_part_is_encoded_once(tool):
    tool.encode_batch(["Word, word.\nWORD (word)", "wörd;\tword"])
    assert set(tool.young) <= {"word", ",", ".", "(", ")", "wörd", ";", "wörd;\tword"}
    known = dict(tool.young)
    tool.encode_batch(["word), (Word."])
    assert set(tool.young) - set(known) <= {"),", "."}


def test_ids_are_those_of_the_library(tool):
    rng = random.Random(3)
    letters = "aAsStTdDbB'<|>., !?19Àßÿµª×\n\t\r 　ñœŒİж中ع😀̀\x00\x85"
    pieces = ["don't", "IT'S", "café", "3.14", "<|", "|>", "'ll", "<|endoftext|>", "x" * 60, "é" * 70, "word"]
    texts = ["", " ", "\n", "!'s 's'"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(pieces) for _ in range(9)) for _ in range(1000)]
    want = [e.ids for e in tool.library.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        assert [ids.tolist() for ids in tool.encode_batch(texts)] == want


def test_plain_parts_of_a_batch_are_judged_at_once(monkeypatch):
    tool = token_files.CachedTokenizer(token_files.tokenizer_path())
    asked = []
    monkeypatch.setattr(token_files.CachedTokenizer, "_simple", lambda self, text, old=token_files.CachedTokenizer._simple: (
        asked.append(text), old(self, text))[1])
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}, it's <a| {i}" for i in range(300)), "ab<|cd", "µ | <|x", ""]
    want = [e.ids for e in tool.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in tool.encode_batch(texts)] == want
    asked.clear()
    text = " ".join(f"new{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    assert tool.encode_batch([text])[0].tolist() == tool.library.encode(text, add_special_tokens=False).ids
    assert len(asked) == 2  # the text and its new parts; before, each part
