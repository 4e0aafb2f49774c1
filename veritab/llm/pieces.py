"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

For merge-type vocabularies the text starts as characters; the agenda holds the
adjacent pairs whose join is a piece, best score first and leftmost among
equals, and joins until none is left. Characters that no piece covers become
bytes. No join can cross a place where the two characters meet in no piece, so a
text is cut there and each distinct word is encoded once per worker, the agendas
of many short words side by side in arrays; every word new to a worker is checked against the sentencepiece library, a batch at
a time, and a difference ends the job.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import query, table
from veritab.llm.words import small_batches

SPACE = "▁"
CACHE_ENTRIES = 200_000
BATCH_BYTES = 2 << 20
LONGEST_CACHED = 64
MANY = 20_000


class PieceEncoder:
    """Encoder and decoder for one model file of merge type without a normalizer map."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (
            lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.scores = {pieces[i]: lib.get_score(i) for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.meetings = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(m[1] == SPACE and m[0] != SPACE for m in self.meetings):
            raise ValueError("pieces span words; texts cannot be cut before a space")
        if lib.normalize("a  ﬁ") != SPACE + "a" + 2 * SPACE + "ﬁ":
            raise ValueError("only models that keep the text as it is are supported")
        self._prepare_agendas()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_symbols(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already marked, from the agenda."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        if n == 1:
            return self._symbol_ids(text)
        scores = self.scores
        agenda = []
        for i, pair in enumerate(map(add, text, text[1:])):
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        if len(agenda) > 1:
            heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, joined = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or left + right != joined:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = joined + symbols[k]
                if pair in scores:
                    heappush(agenda, (-scores[pair], i, k, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + joined
                if pair in scores:
                    heappush(agenda, (-scores[pair], h, i, pair))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                ids += self._symbol_ids(s)
        return ids

    def _symbol_ids(self, symbol: str) -> list[int]:
        if symbol in self.ids:
            return [self.ids[symbol]]
        return [self.bytes[b] for b in symbol.encode()]

    def _prepare_agendas(self) -> None:
        """Tables for many agendas at once: symbol numbers of characters, and the join of each symbol pair."""
        numbers = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                numbers.setdefault(c, self.library.get_piece_size() + len(numbers))
        self.of_char = np.full(0x110000, -1, np.int64)
        for symbol, number in numbers.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = number
        joins = {}
        for piece, number in self.ids.items():
            for k in range(1, len(piece)):
                if piece[:k] in numbers and piece[k:] in numbers:
                    joins[numbers[piece[:k]] << 24 | numbers[piece[k:]]] = (number, -self.scores[piece])
        keys = sorted(joins)
        self.pair_keys = np.array([*keys, 1 << 62], np.int64)
        self.pair_joins = np.array([*[joins[k][0] for k in keys], -1], np.int64)
        self.pair_costs = np.array([*[joins[k][1] for k in keys], np.inf])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, the last place for pairs without a join."""
        keys = left << 24 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), at, len(self.pair_keys) - 1)

    def encode_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """:meth:`encode_symbols` of many short words."""
        ids, ends = self._agendas(words)
        return [tuple(ids[a:b].tolist()) for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and where each word's end: each round joins the first pair of every word's agenda."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.of_char[points]
        chars = points.astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        pair = self._pairs(symbols[:-1], symbols[1:])
        none = len(self.pair_keys) - 1
        pair = np.append(np.where(owner[:-1] == owner[1:], pair, none), none)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            cost = self.pair_costs[pair]
            least = np.minimum.reduceat(cost, first)
            lengths = np.diff(np.append(first, len(symbols)))
            over = np.repeat(np.isinf(least), lengths)
            if over.any():
                done.append((owner[over], symbols[over], chars[over]))
                keep = ~over
                symbols, chars, owner, pair, cost = symbols[keep], chars[keep], owner[keep], pair[keep], cost[keep]
                lengths, least = lengths[~np.isinf(least)], least[~np.isinf(least)]
                if not len(symbols):
                    break
            best = np.flatnonzero(cost == np.repeat(least, lengths))
            at = best[np.append(True, owner[best][1:] != owner[best][:-1])]
            symbols[at] = self.pair_joins[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            symbols, chars, owner, pair = symbols[keep], chars[keep], owner[keep], pair[keep]
            for left in (at, at[at > 0] - 1):
                inside = left + 1 < len(symbols)
                own = left[inside]
                same = owner[own] == owner[own + 1]
                pair[left] = none
                pair[own] = np.where(same, self._pairs(symbols[own], symbols[own + 1]), none)
        owner, symbols, chars = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(owner, kind="stable")
        owner, symbols, chars = owner[order], symbols[order], chars[order]
        spelled = np.flatnonzero((symbols < 0) | (symbols >= self.library.get_piece_size()))
        if len(spelled):  # characters that are no piece, as bytes
            spelling = [[self.bytes[b] for b in chr(c).encode()] for c in chars[spelled].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[spelled] = [len(ids) for ids in spelling]
            owner, symbols, is_byte = np.repeat(owner, sizes), np.repeat(symbols, sizes), np.zeros(len(symbols), bool)
            is_byte[spelled] = True
            symbols[np.repeat(is_byte, sizes)] = list(chain.from_iterable(spelling))
        return symbols, np.searchsorted(owner, np.arange(len(words)), "right")

    def _stretches(self, word: str) -> list[str]:
        if self.meetings.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.meetings]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for s in self._stretches(word):
            ids += self.encode_symbols(s)
        return tuple(ids)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without begin or end ids."""
        rows = [self._words(t) for t in texts]
        young, old = self.young, self.old
        words = list(chain.from_iterable(rows))
        held = list(map(young.get, words))
        gaps = [i for i, packed in enumerate(held) if packed is None]
        missing = {words[i] for i in gaps}
        here = {w: old[w] for w in missing if w in old}
        young.update(here)
        new = list(missing.difference(here))
        fresh = dict(zip(new, self._fresh([w if SPACE in w else SPACE + w for w in new])))
        here.update(fresh)
        young.update((w, packed) for w, packed in fresh.items() if len(w) < LONGEST_CACHED)
        for i in gaps:
            held[i] = here[words[i]]
        ends = list(accumulate(map(len, rows)))
        out = [np.frombuffer(b"".join(held[a:b]), "<u4") for a, b in zip([0, *ends], ends)]
        if len(young) > CACHE_ENTRIES:  # keep what recent batches used
            self.old, self.young = young, {}
        return out

    def _fresh(self, marked: list[str]) -> list[bytes]:
        """Packed ids of words whose spaces are marked, each as the library gives them."""
        out = [b""] * len(marked)
        short = [i for i, w in enumerate(marked) if len(w) <= LONGEST_CACHED]
        groups = [short[at:at + MANY] for at in range(0, len(short), MANY)]
        groups += [[i] for i, w in enumerate(marked) if len(w) > LONGEST_CACHED]
        for group in groups:
            words = [marked[i] for i in group]
            if len(words[0]) > LONGEST_CACHED:
                ids = np.array(self._word(words[0]), np.int64)
                ends = np.array([len(ids)])
            else:
                ids, ends = self._agendas(words)
            self._check(words, ids, ends)
            packed, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            for i, a, b in zip(group, [0, *cuts], cuts):
                out[i] = packed[a:b]
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words of a text: plain ones without their mark, those with several or inner marks as they are."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        return text.split(" ")

    def _check(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """The library must give the same ids; it adds the first space itself, so words without one are not asked for."""
        asked = [i for i, w in enumerate(words) if w[0] == SPACE and len(w) > 1]
        found = self.library.encode([words[i][1:] for i in asked], num_threads=1)
        sizes = np.diff(ends, prepend=0)
        if len(asked) < len(words):
            known = np.zeros(len(words), bool)
            known[asked] = True
            ids, sizes = ids[np.repeat(known, sizes)], sizes[known]
        if (np.fromiter(map(len, found), np.int64) == sizes).all() and (
                np.fromiter(chain.from_iterable(found), np.int64) == ids).all():
            return
        cuts = np.cumsum(sizes).tolist()
        for i, theirs, a, b in zip(asked, found, [0, *cuts], cuts):
            if theirs != ids[a:b].tolist():
                raise ValueError(f"encoding of {words[i][:200]!r} differs from the library: {ids[a:b].tolist()} and {theirs}")

    def decode_batch(self, rows: list[np.ndarray]) -> list[str]:
        return [self.library.decode(ids.tolist()) if len(ids) else "" for ids in rows]


# A word is a run of marked spaces with the text up to the next one.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    return PieceEncoder(model_file)


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    tool = encoder(model_file)
    gc.disable()  # nothing here forms cycles, and the caches hold very many small objects
    for batch in small_batches(batches, size=BATCH_BYTES):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = tool.encode_batch(texts)
        decoded = tool.decode_batch(ids)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "ids": pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()),
                pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))),
            "decoded": pa.array(decoded, pa.string()),
        })


def encoded_texts(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the ids of the whole text and the text decoded from them.

    Ids are those of the sentencepiece library without begin or end ids and
    without sampling. A NULL or empty text has no ids and decodes to an empty
    text. Rows without or with repeated ids are encoded like any other; other
    columns are ignored; an empty table gives no rows.
    """
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text"))
    return source.mapInArrow(partial(_encoded, model_file=model_file or model_path()),
                             "doc_id long, ids array<int>, decoded string")


@lru_cache(maxsize=1)
def _digits(size: int) -> np.ndarray:
    """The numbers below ``size`` as decimal digits with a comma, in rows filled with zero bytes."""
    return np.array([b"%d," % i for i in range(size)]).view(np.uint8).reshape(size, -1)


def _decimals(ids: np.ndarray) -> bytes:
    """Decimal numbers joined by commas."""
    if not len(ids):
        return b""
    letters = _digits(1 << max(15, int(ids.max()).bit_length())).take(ids, axis=0).ravel()
    return letters[letters != 0].tobytes()[:-1]


def _digests(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    for batch in _encoded(batches, model_file):
        column = batch.column("ids")
        cuts, flat = column.offsets.to_pylist(), column.values.to_numpy()
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(np.diff(cuts), pa.int64()),
            "ids_sha256": [hashlib.sha256(_decimals(flat[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:])],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()],
        })


def encoded_digests(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encoded_texts`, made where the ids are."""
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text"))
    return source.mapInArrow(partial(_digests, model_file=model_file or model_path()),
                             "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op5_encoded_texts")
def _encoded_texts(spark, folder):
    return encoded_digests(table(spark, folder, "documents"))
