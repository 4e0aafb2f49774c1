"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A file holds a run of documents in ascending doc_id order: a magic word, the
number of documents, the SHA-256 of the dictionary, then for each document its id
and the end of its frame, then the frames. A frame is a document's ids as
little-endian 32-bit words, split into byte planes and compressed alone, so one
document is read by its offsets without touching the rest. The dictionary is
trained on a bounded sample (``DICTIONARY_DOCUMENTS`` documents by hash of the
id, a parameter); it changes sizes only, never contents.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from veritab.functions.ranking import hashed_sample
from veritab.llm.base import Scratch, query, table
from veritab.llm.words import small_batches

MAGIC = b"VTOKENS1"
END_ID = 1
FILE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
DICTIONARY_DOCUMENTS = 1000
LEVEL = 3
CACHE_ENTRIES = 250_000
LONGEST_CACHED = 48

# The word pattern of the tokenizer's file, and the same for lower-case printable Western letters and signs.
_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SIMPLE = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \n]+")


# Byte-level vocabularies write bytes as printable letters: printable ones as they are, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_LETTERS = {b: b if b in _PRINTABLE else 256 + _OTHERS.index(b) for b in range(256)}


def _byte_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def pack_ids(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class CachedTokenizer:
    """Ids of whole texts from the tokenizers library, each distinct part of a text encoded once per worker.

    Only for tokenizers that drop white space and never join across it: texts are
    cut at spaces and line feeds, which leaves the ids as they are. A text of plain
    Western letters and signs is cut by the tokenizer's own word pattern at once.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        if any(" " in t or "\n" in t for t in special):
            raise ValueError("special tokens with spaces: texts cannot be cut")
        for probe in ("ab cd.  ef", "Ab, 12 c'd\nx"):
            parts = [i for w in re.split("[ \n]+", probe) for i in self._encode([w])[0]]
            if parts != list(self.library.encode(probe, add_special_tokens=False).ids):
                raise ValueError("this tokenizer does not drop white space: texts cannot be cut")
        with open(path, encoding="utf-8") as file:
            self.cuts = _PATTERN in json.dumps(json.load(file)["pre_tokenizer"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _simple(self, text: str) -> bool:
        return self.cuts and "<|" not in text and _SIMPLE.fullmatch(text) is not None

    def _cut(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart: matches of the word pattern, or whole words where that is not plain."""
        if self._simple(text):
            return _PARTS.findall(text.lower())
        parts: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if self._simple(word):
                parts += _PARTS.findall(word.lower())
            else:
                parts.append(word)
        return parts

    def _fresh(self, parts: list[str]) -> dict[str, bytes]:
        plain, other = parts, []
        if not self._simple(" ".join(parts)):
            plain = [p for p in parts if self._simple(p)]
            other = [p for p in parts if not self._simple(p)]
        tokenize = self.library.model.tokenize
        ids = [[t.id for t in tokenize(p if p.isascii() else _byte_letters(p))] for p in plain] + self._encode(other)
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, ids))]
        return {p: packed[a:b] for p, a, b in zip(plain + other, [0, *ends], ends)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        rows = [self._cut(t) for t in texts]
        young, old = self.young, self.old
        parts = list(chain.from_iterable(rows))
        held = list(map(young.get, parts))
        gaps = [i for i, packed in enumerate(held) if packed is None]
        missing = {parts[i] for i in gaps}
        here = {p: old[p] for p in missing if p in old}
        young.update(here)
        fresh = self._fresh(list(missing.difference(here)))
        here.update(fresh)
        young.update((p, packed) for p, packed in fresh.items() if len(p) <= LONGEST_CACHED)
        for i in gaps:
            held[i] = here[parts[i]]
        ends = list(accumulate(map(len, rows)))
        out = [np.frombuffer(b"".join(held[a:b]), "<u4") for a, b in zip([0, *ends], ends)]
        if len(young) > CACHE_ENTRIES:
            self.old, self.young = young, {}
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def _planes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def train_dictionary(samples: list[np.ndarray]) -> bytes:
    """A zstandard dictionary for serialized id arrays; a raw one of the samples where they are too few to train on."""
    data = [_planes(s)[:128 << 10] for s in samples if len(s) > 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[:DICTIONARY_BYTES] or b"\0" * 8


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(
        data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def pack(ids: list[int | None], arrays: list[np.ndarray], dictionary: bytes) -> bytes:
    """One file of documents."""
    tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
    return pack_frames(ids, [tool.compress(_planes(a)) for a in arrays], dictionary)


def pack_frames(ids: list[int | None], frames: list[bytes], dictionary: bytes) -> bytes:
    ends = np.cumsum([len(f) for f in frames], dtype=np.int64)
    known = np.array([i is not None for i in ids], np.uint8)
    return b"".join([MAGIC, struct.pack("<q", len(ids)), hashlib.sha256(dictionary).digest(), known.tobytes(),
                     np.array([i or 0 for i in ids], "<i8").tobytes(), ends.astype("<i8").tobytes(), *frames])


class TokenFile:
    """Reads documents of one packed file by their place in it."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<q", data, 8)[0]
        if data[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        known = np.frombuffer(data, np.uint8, n, 48)
        ids = np.frombuffer(data, "<i8", n, 48 + n)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.ends = np.frombuffer(data, "<i8", n, 48 + 9 * n)
        self.data, self.start = data, 48 + 17 * n
        self.tool = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __getitem__(self, place: int) -> np.ndarray:
        low = self.start + (int(self.ends[place - 1]) if place else 0)
        return _from_planes(self.tool.decompress(self.data[low:self.start + int(self.ends[place])]))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    gc.disable()  # nothing here forms cycles, and the caches hold very many small objects
    tool = tokenizer(path)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
    context = TaskContext.get()
    store, root = fs.FileSystem.from_uri(folder)
    ids: list[int | None] = []
    frames: list[bytes] = []
    size, number, tokens = 0, 0, 0

    def close() -> pa.RecordBatch:
        # A task that runs again writes the same name again; the whole file appears at once.
        name = f"part-{context.partitionId():06d}-{number:06d}"
        partial_name = f"{root}/_attempt-{context.taskAttemptId()}-{name}"
        with store.open_output_stream(partial_name) as out:
            out.write(pack_frames(ids, frames, dictionary))
        store.move(partial_name, f"{root}/{name}.tokens")
        return pa.record_batch({"file": [f"{name}.tokens"], "n_documents": pa.array([len(ids)], pa.int64()),
                                "n_tokens": pa.array([tokens], pa.int64())})

    for batch in small_batches(batches, size=2 << 20):
        arrays = tool.encode_batch([t or "" for t in batch.column("text").to_pylist()])
        for doc, array in zip(batch.column("doc_id").to_pylist(), arrays):
            array = np.append(array, np.uint32(END_ID))
            ids.append(doc)
            frames.append(press.compress(_planes(array)))
            size += len(frames[-1]) + 17
            tokens += len(array)
            if size >= FILE_BYTES:
                yield close()
                ids, frames, size, number, tokens = [], [], 0, number + 1, 0
    if ids:
        yield close()


def _read(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            file = TokenFile(content.as_py(), dictionary)
            arrays = [file[i] for i in range(len(file.ids))]
            lengths = np.array([len(a) for a in arrays], np.int64)
            yield pa.record_batch({
                "file": pa.array([name] * len(arrays)), "doc_id": pa.array(file.ids, pa.int64()),
                "inside": pa.array(np.cumsum(lengths) - lengths), "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64())})


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(documents: DataFrame, folder: str, path: str | None = None, dictionary: bytes | None = None,
                      ) -> tuple[DataFrame, bytes]:
    """Write ``documents(doc_id, text)`` as token files; returns ``file, n_documents, n_tokens`` and the dictionary.

    Files follow each other in ascending doc_id order by name. ``folder`` must be
    one that all executors reach. A NULL or empty text has the end id only; rows
    without a doc_id come first; repeated rows are written each; other columns are
    ignored; an empty table writes no file.
    """
    path = path or tokenizer_path()
    source = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text"))
    if dictionary is None:
        sample = hashed_sample(source, F.col("doc_id"), DICTIONARY_DOCUMENTS, source.count()).filter(
            "text IS NOT NULL").select(F.substring("text", 1, 20_000).alias("text")).collect()
        dictionary = train_dictionary(tokenizer(path).encode_batch([r["text"] for r in sample]))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # Equal ids may be many: the text's hash splits them between ranges.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    written = ordered.mapInArrow(partial(_write, folder=folder, path=path, dictionary=dictionary),
                                 "file string, n_documents long, n_tokens long")
    return written, dictionary


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, dictionary: bytes) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts all ids before it.

    ``files`` has one row per file of about ``FILE_BYTES`` and is small enough to be numbered in one task.
    """
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    documents = content.mapInArrow(partial(_read, dictionary=dictionary),
                                   "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return documents.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query("op7_token_files")
def _token_files(spark, folder):
    scratch = Scratch(spark)
    target = scratch.path()
    files, dictionary = write_token_files(table(spark, folder, "documents"), target)
    return read_token_files(spark, target, scratch.write(files), dictionary)
