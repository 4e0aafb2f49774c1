"""License scan by conditional compression, confirmed by exact wording.

Around every license word a window as long as a template is taken, for each
template, and the template is compressed with the window as a raw zstandard
dictionary: what that saves of its own compressed size says how much of it the
window holds, however much else stands there. Templates that are saved by
``LEAST_SAVED`` or more are candidates, and only those are confirmed word by word: a
find has enough of the template's words in order. The find is then compressed as it
is and with the template as dictionary. Of finds in one place the one whose template
saves most, as a share of its own size, wins, then the one with the fewest
differences. Windows count by words, so line breaks, letter case and comment signs
do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import query, table
from veritab.llm.words import small_batches

LEAST_COVERED = 80  # percent
LEAST_SAVED = 0.05  # of a template's own compressed size; confirmed finds in random words measured 0.12 at least

# Wordings of common licenses and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MIT-notice": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must retain the "
                    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
                    "binary form must reproduce the above copyright notice, this list of conditions and the following "
                    "disclaimer in the documentation and/or other materials provided with the distribution.",
}
# Words one of which every wording holds.
MARKERS = r"(?i)licen[sc]e|rights reserved|permission|redistribution|copyright|creative commons"
_MARKER = re.compile(MARKERS)
_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def differences(block: list[str], template: list[str]) -> tuple[int, int, int, int]:
    """Template words found in order, foreign words between the found ones, and the places of the first and last found."""
    wanted, piece = np.array(template), np.array(block)
    lengths = np.zeros((len(piece) + 1, len(wanted) + 1), np.int32)
    for i in range(len(piece) - 1, -1, -1):
        row = np.where(wanted == piece[i], lengths[i + 1, 1:] + 1, lengths[i + 1, :-1])
        lengths[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    # Start as late as the full count allows, so that foreign words before the wording do not count.
    start = int(np.flatnonzero(lengths[:, 0] == lengths[0, 0])[-1])
    i, j, last, hits = start, 0, start, 0
    while i < len(piece) and j < len(wanted):
        if piece[i] == wanted[j]:
            hits, last, i, j = hits + 1, i, i + 1, j + 1
        elif lengths[i + 1, j] >= lengths[i, j + 1]:
            i += 1
        else:
            j += 1
    return hits, last - start + 1 - hits if hits else 0, start, last


def _under(text: bytes) -> zstandard.ZstdCompressor:
    """A compressor that has a text as its raw dictionary."""
    return zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
        text + b"\0" * max(0, 8 - len(text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class LicenseScanner:
    """The templates as words and as raw dictionaries."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = {n: [w.lower() for w in _WORD.findall(templates[n])] for n in self.names}
        self.bags = {n: Counter(w) for n, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.texts = {n: " ".join(w).encode() for n, w in self.words.items()}
        self.sizes = {n: len(self.plain.compress(t)) for n, t in self.texts.items()}
        self.tools = {n: _under(t) for n, t in self.texts.items()}

    def held(self, words: list[str], name: str) -> float:
        """What words save of a template's compressed size when they are its dictionary, as a share of that size."""
        return 1 - len(_under(" ".join(words).encode()).compress(self.texts[name])) / self.sizes[name]

    def saved(self, words: list[str], name: str) -> float:
        """What the template saves of the words' compressed size when it is their dictionary, as a share of its own."""
        data = " ".join(words).encode()
        return (len(self.plain.compress(data)) - len(self.tools[name].compress(data))) / self.sizes[name]

    def scan(self, text: str) -> list[tuple[int, int, str, float, int, int, int]]:
        """``(first line, last line, name, saved share, found, missing, foreign)`` of every wording, by place."""
        places = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
        starts, words = [p for p, _ in places], [w for _, w in places]
        marks = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in _MARKER.finditer(text)}) if words else []
        found = set()
        for name in self.names:
            reach = len(self.words[name]) * (200 - LEAST_COVERED) // 100
            seen: set[tuple[int, int]] = set()
            for mark in marks:
                low, high = max(0, mark - reach), mark + reach + 1
                if not any(a <= mark <= b for a, b in seen) and self.held(words[low:high], name) >= LEAST_SAVED:
                    self._search(words, low, high, name, seen, found)
        best: list[tuple] = []
        for hit in sorted(found):
            _, _, _, name, _, first, last, _, _, _ = hit
            # A find inside a longer one of another kind stays; two of about one stretch are one.
            if all(2 * (min(last, h[6]) - max(first, h[5]) + 1) <= max(last - first, h[6] - h[5]) + 1 for h in best):
                best.append(hit)
        breaks = [i for i, c in enumerate(text) if c == "\n"] if best else []
        return sorted((bisect_right(breaks, starts[h[5]]), bisect_right(breaks, starts[h[6]]), h[3], h[4], *h[7:]) for h in best)

    def _search(self, words: list[str], low: int, high: int, name: str, seen: set, found: set) -> None:
        """All stretches of ``words[low:high]`` that hold enough of a template; the best one first, then what lies around it."""
        wanted, bag = self.words[name], self.bags[name]
        n, piece = len(wanted), words[low:high]

        def enough(part: list[str]) -> bool:
            return 100 * (bag & Counter(part)).total() >= LEAST_COVERED * n

        if not enough(piece):
            return
        hits, foreign, first, last = differences(piece, wanted)
        span = n * (200 - LEAST_COVERED) // 100
        if 100 * foreign > (100 - LEAST_COVERED) * n:
            # The words found lie too far apart: look for enough of them in any shorter stretch.
            tries = []
            for at in range(max(0, len(piece) - n * LEAST_COVERED // 100) + 1):
                if piece[at:at + 1] and piece[at] in bag and enough(part := piece[at:at + span]):
                    h, f, a, b = differences(part, wanted)
                    if 100 * h >= LEAST_COVERED * n and 100 * f <= (100 - LEAST_COVERED) * n:
                        tries.append((n - h + f, at + a, at + b, h, f))
            if not tries:
                return
            _, first, last, hits, foreign = min(tries)
        elif 100 * hits < LEAST_COVERED * n:
            return
        share = self.saved(piece[first:last + 1], name)
        missing = n - hits
        found.add((-share, missing + foreign, -hits, name, share, low + first, low + last, hits, missing, foreign))
        seen.add((low + first, low + last))
        self._search(words, low, low + first, name, seen, found)
        self._search(words, low + last + 1, min(high, len(words)), name, seen, found)


def _scan(batches: Iterator[pa.RecordBatch], templates: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    tool = LicenseScanner(templates)
    for batch in small_batches(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            rows += [(doc, *hit) for hit in tool.scan(text or "")]
        names = ["doc_id", "first_line", "last_line", "license", "saved", "n_found", "n_missing", "n_foreign"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def license_blocks(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per license wording found in a document, at each place.

    ``doc_id, first_line, last_line`` of the wording (lines from 0), ``license``,
    ``saved`` (what the template saves of the find's compressed size, as a share of
    its own), and how many of the template's words were found in order, are
    missing, and how many other words lie between. NULL and empty texts give no
    rows; rows without or with repeated ids are scanned each; other columns are
    ignored.
    """
    marked = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                              documents["text"].cast("string").alias("text")).filter(F.col("text").rlike(MARKERS))
    return marked.mapInArrow(
        partial(_scan, templates=dict(templates)),
        "doc_id long, first_line long, last_line long, license string, saved double, n_found long, n_missing long, "
        "n_foreign long")


@query("op3_license_blocks")
def _license_blocks(spark, folder):
    return license_blocks(table(spark, folder, "documents"))
