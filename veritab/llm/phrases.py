"""Collocations by vertically partitioned suffix subtrees (after ERA: Mansour et al., 2011).

The texts are strings over words, cut where a piece ends. No phrase is longer
than ``max_words``, so suffixes are truncated to that depth. The suffixes are
partitioned vertically, by the words they begin with: the prefixes are dealt
into groups such that the suffixes of one group fit a memory budget. A prefix
is one word; a word so frequent that it could fill half a budget is extended by
the next word, and so on while all words of the prefix are that frequent. Each
group builds its subtree on its own: it sorts its truncated suffixes, finds the
common prefixes of neighbours, and reads the count of every node from the totals
of the leaves below it. Only nodes that an extended prefix has split between
groups have to be added up afterwards.

Before the shuffle a batch collapses equal suffixes. Words too rare for any
phrase end a suffix. On the way words are numbered by falling frequency, so that
a suffix takes four bytes a word; the numbers of the ``DICTIONARY_WORDS`` most
frequent words are known to all tasks, other words are sent as their hashes.
Two words of one hash are found when words are counted, and other hashes are
taken then, so all counts are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.llm.base import Scratch, query, table
from veritab.llm.words import _LOWER, mix, small_batches, text_buffers, word_spans

DICTIONARY_WORDS = 1 << 21
BUDGET_SUFFIXES = 1 << 21
COUNTED_BYTES = 4 << 20
SUFFIX_BYTES = 2 << 20
_UNKNOWN = np.uint64(1 << 63)

# Where a piece ends, and what separates words inside one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_SPACES = b" \t"

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(PIECE_ENDS)] = True
_SPACES = _ENDS.copy()
_SPACES[list(WORD_SPACES)] = True


def collocations(
    documents: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    cover_percent: int = 50,
    top: int | None = 2000,
    budget: int = BUDGET_SUFFIXES,
    dictionary: int = DICTIONARY_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language by how much their words cling together.

    Candidates are phrases of 2 to ``max_words`` words of one piece that occur
    ``min_count`` times or more (``a``, overlapping occurrences included). Cut in
    two, the parts occur ``l`` and ``r`` times, and the score is
    ``floor(1000000 * a * a / (l * r))`` of the cut where it is lowest, the first of
    equal ones. A candidate inside a longer one that occurs ``cover_percent`` of its
    times or more is dropped. ``n`` counts the words of the language. ``top`` limits
    the rows of a language (score, then ``a`` descending, then the phrase by its
    bytes); None keeps all.

    A NULL text is empty, a NULL language is ``und``; repeated rows count each
    time; only ``text`` and ``lang`` are read. Where no phrase is frequent enough,
    or the table is empty, the result is empty.
    """
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    scratch = Scratch(documents.sparkSession)
    texts = documents.select(
        F.coalesce(documents["lang"].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    salt, counted = 0, _counted(scratch, texts, 0)
    while not counted.filter("clash").isEmpty():
        scratch.drop(counted)
        salt += 1
        counted = _counted(scratch, texts, salt)
    words = counted.filter(F.col("f") >= min_count).select("code", "lang", "word", "f")
    nodes = _frequent_nodes(scratch, texts, counted, salt, max_words, min_count, budget, dictionary)
    candidates = scratch.write(nodes)
    known = candidates.unionByName(words.select(F.array("code").alias("words"), "f"))
    kept = _uncovered(_scored(candidates, known), candidates, cover_percent)

    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    placed = kept.join(words.select(F.col("code").alias("first"), "lang"), F.col("words")[0] == F.col("first"))
    if top is not None:
        placed = placed.withColumn("place", F.rank().over(
            Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    placed = scratch.write(placed.select("words", "lang", "a", "l", "r", "score"))
    spelled = placed.select("words", F.posexplode("words").alias("at", "code")).join(
        words.select("code", "word"), "code").groupBy("words").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
        .alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = placed.join(spelled, "words").join(totals, "lang").withColumn("rank", rank.cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _counted(scratch: Scratch, texts: DataFrame, salt: int) -> DataFrame:
    """``code, lang, word, f`` of every word; ``clash`` marks a code that two words share."""
    seen = texts.mapInArrow(partial(_word_counts, salt=salt), "code long, lang string, word string, f long")
    name = F.struct("lang", "word")
    return scratch.write(seen.groupBy("code").agg(
        F.min(name).alias("low"), F.max(name).alias("high"), F.sum("f").alias("f")).select(
        "code", "low.lang", "low.word", "f", (F.col("low") != F.col("high")).alias("clash")))


def _frequent_nodes(
    scratch: Scratch, texts: DataFrame, counted: DataFrame, salt: int, max_words: int, min_count: int, budget: int,
    dictionary: int,
) -> DataFrame:
    """``words, f`` of every phrase of 2 to ``max_words`` words that occurs ``min_count`` times."""
    total = counted.agg(F.sum("f")).first()[0] or 0
    numbered, complete = _numbered(counted, min_count, dictionary)
    heavy = int((numbered["f"] > budget // 2).sum())
    groups = max(1, math.ceil(2 * total / budget))
    numbers = scratch.spark.sparkContext.broadcast((numbered["code"], np.argsort(numbered["code"]), complete))
    suffixes = texts.mapInArrow(
        partial(_suffixes, salt=salt, numbers=numbers, depth=max_words, heavy=heavy, groups=groups),
        "`group` long, columns binary, counts binary, code_bytes int, count_bytes int")

    def subtree(group: pa.Table) -> pa.Table:
        return _subtree(group, numbers, max_words, heavy, min_count)

    nodes = suffixes.groupBy("group").applyInArrow(subtree, "words array<long>, f long")
    return nodes.groupBy("words").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def _numbered(counted: DataFrame, min_count: int, most: int) -> tuple[dict[str, np.ndarray], bool]:
    """Codes and counts of at most ``most`` words by falling frequency, and whether all frequent words are among them.

    A histogram of the counts' bit lengths and leading bits (a few hundred rows)
    finds the lowest count that leaves few enough words.
    """
    frequent = counted.filter(F.col("f") >= min_count)
    step = F.expr("shiftleft(1L, greatest(length(bin(f)) - 5, 0))")
    bins = sorted(((r["least"], r["held"]) for r in frequent.groupBy(
        (F.floor(F.col("f") / step) * step).cast("long").alias("least")).agg(F.count(F.lit(1)).alias("held")).collect()),
        reverse=True)
    least, held = None, 0
    for low, count in bins:
        if held + count > most:
            break
        least, held = low, held + count
    if least is None:
        none = np.zeros(0, np.int64)
        return {"code": none.view(np.uint64), "f": none}, not bins
    rows = frequent.filter(F.col("f") >= least).select("code", "f").toArrow()
    codes, f = rows["code"].to_numpy(), rows["f"].to_numpy()
    order = np.lexsort((codes, -f))
    return {"code": codes[order].view(np.uint64), "f": f[order]}, least == bins[-1][0]


def _seeds(langs: pa.Array, salt: int) -> np.ndarray:
    """One random 64-bit value for each row's language."""
    coded = langs.dictionary_encode()
    values = [int.from_bytes(hashlib.blake2b(f"{salt}:{x}".encode(), digest_size=8).digest(), "little")
              for x in coded.dictionary.to_pylist()]
    return np.array(values, np.uint64)[coded.indices.to_numpy()]


def _coded(batch: pa.RecordBatch, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, code (63 bits), first byte and end of every word of a batch, and the batch's bytes."""
    places, hashes, starts, stops = word_spans(batch.column("text"), _SPACES)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(places))
    _, raw = text_buffers(batch.column("text"))
    codes = mix(hashes ^ _seeds(batch.column("lang"), salt)[rows]) & ~_UNKNOWN
    return rows, codes, starts, stops, raw


def _word_counts(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, size=COUNTED_BYTES):
        rows, codes, starts, stops, raw = _coded(batch, salt)
        if not len(codes):
            continue
        unique, at, counts = np.unique(codes, return_index=True, return_counts=True)
        sizes = (stops - starts)[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        chars = _LOWER[raw[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], sizes)]]
        spelled = pa.Array.from_buffers(
            pa.large_string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.tobytes())])
        yield pa.record_batch({
            "code": pa.array(unique.view(np.int64)), "lang": batch.column("lang").take(pa.array(rows[at])),
            "word": spelled.cast(pa.string()), "f": pa.array(counts, pa.int64())})


def _suffixes(
    batches: Iterator[pa.RecordBatch], salt: int, numbers: Broadcast, depth: int, heavy: int, groups: int,
) -> Iterator[pa.RecordBatch]:
    """The distinct truncated suffixes of each batch with their counts, one row for each group of prefixes."""
    by_number, order, complete = numbers.value
    in_order = by_number[order]
    for batch in small_batches(batches, size=SUFFIX_BYTES):
        rows, codes, starts, _, raw = _coded(batch, salt)
        if len(codes) < 2:
            continue
        pieces = np.searchsorted(np.flatnonzero(_ENDS[raw]), starts)
        follows = np.append((pieces[1:] == pieces[:-1]) & (rows[1:] == rows[:-1]), False)
        # Word numbers count from 1; 0 ends a suffix.
        sent = np.zeros(len(codes), np.uint64) if complete else codes | _UNKNOWN
        if len(by_number):
            found = np.minimum(np.searchsorted(in_order, codes), len(in_order) - 1)
            sent = np.where(in_order[found] == codes, order[found].astype(np.uint64) + np.uint64(1), sent)
        columns = _truncated(sent, follows, depth)
        long_enough = columns[1] > 0
        columns = [c[long_enough] for c in columns]
        if not len(columns[0]):
            continue
        if max(int(c.max()) for c in columns) < 1 << 32:
            columns = [c.astype(np.uint32) for c in columns]
        columns, counts = _collapsed(columns, np.ones(len(columns[0]), np.int64))
        group = _group(columns, heavy, groups)
        by_group = np.argsort(group, kind="stable")
        columns, counts, group = [c[by_group] for c in columns], counts[by_group], group[by_group]
        counts = counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint64)
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(cuts[1:], len(group))
        yield pa.record_batch({
            "group": pa.array(group[cuts], pa.int64()),
            "columns": pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "code_bytes": pa.array([columns[0].itemsize] * len(cuts), pa.int32()),
            "count_bytes": pa.array([counts.itemsize] * len(cuts), pa.int32())})


def _truncated(sent: np.ndarray, follows: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each place the words of its suffix, column by column, 0 behind its end."""
    columns, open_here = [sent], sent > 0
    for d in range(1, depth):
        # The word d places on belongs to the suffix while every step up to it stays in the piece.
        open_here[:max(0, len(sent) - d + 1)] &= follows[d - 1:]
        here = np.zeros(len(sent), sent.dtype)
        here[:max(0, len(sent) - d)] = sent[d:]
        here[~open_here] = 0
        open_here &= here > 0
        columns.append(here)
    return columns


def _collapsed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes in order, with the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


def _group(columns: list[np.ndarray], heavy: int, groups: int) -> np.ndarray:
    """The group of each suffix: by its first word, or by as many as it takes to reach one that is not heavy."""
    key = mix(columns[0].astype(np.uint64))
    extended = columns[0] <= heavy
    for c in columns[1:]:
        key = np.where(extended, mix(key + c.astype(np.uint64)), key)
        extended &= c <= heavy
    return (key % np.uint64(groups)).astype(np.int64)


def _subtree(group: pa.Table, numbers: Broadcast, depth: int, heavy: int, least: int) -> pa.Table:
    """The nodes of one group's subtree that occur ``least`` times, or may do so with other groups."""
    parts: list[list[np.ndarray]] = []
    for columns, counts, code_bytes, count_bytes in zip(*[
            group[c].to_pylist() for c in ("columns", "counts", "code_bytes", "count_bytes")]):
        codes = np.frombuffer(columns, np.uint32 if code_bytes == 4 else np.uint64).reshape(depth, -1)
        parts.append([*codes, np.frombuffer(counts, np.uint8 if count_bytes == 1 else np.uint64).astype(np.int64)])
    *columns, counts = [np.concatenate(p) for p in zip(*parts)]
    columns, leaves = _collapsed(columns, counts)
    by_number, _, _ = numbers.value
    # Words each leaf has in common with the leaf before it.
    common, alike = np.zeros(len(leaves), np.int64), np.ones(len(leaves) - 1, bool)
    for c in columns:
        alike &= c[1:] == c[:-1]
        common[1:] += alike
    words, totals = [], []
    whole = columns[0] > heavy
    for d in range(2, depth + 1):
        first = np.flatnonzero(common < d)
        total = np.add.reduceat(leaves, first)
        # A node of heavy words alone may have leaves in other groups, unless it is a leaf itself.
        whole = whole | (columns[d - 1] > heavy)
        wanted = (columns[d - 1][first] > 0) & ((total >= least) | (~whole[first] & (d < depth)))
        first, total = first[wanted], total[wanted]
        node = np.stack([_code(c[first].astype(np.uint64), by_number) for c in columns[:d]], axis=1)
        words.append(pa.FixedSizeListArray.from_arrays(
            pa.array(node.ravel().view(np.int64)), d).cast(pa.list_(pa.int64())))
        totals.append(pa.array(total, pa.int64()))
    return pa.table({"words": pa.chunked_array(words), "f": pa.chunked_array(totals)})


def _code(sent: np.ndarray, by_number: np.ndarray) -> np.ndarray:
    known = sent < _UNKNOWN
    codes = sent & ~_UNKNOWN
    codes[known] = by_number[sent[known].astype(np.int64) - 1]
    return codes


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``words, a, l, r, score`` of every candidate at its lowest-scoring cut."""
    cuts = candidates.select("words", F.col("f").alias("a"), F.explode(
        F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "*", F.slice("words", F.lit(1), F.col("k")).alias("left"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    counted = cuts.join(known.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(
        known.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    # 38 digits hold the products exactly up to counts of 15 digits.
    exact = "decimal(15,0)"
    score = F.expr(f"(CAST(a AS {exact}) * CAST(a AS {exact}) * CAST(1000000 AS decimal(7,0)))"
                   f" div (CAST(l AS {exact}) * CAST(r AS {exact}))")
    best = counted.withColumn("score", score).groupBy("words").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    return best.select("words", "best.a", "best.l", "best.r", "best.score")


def _uncovered(scored: DataFrame, candidates: DataFrame, cover_percent: int) -> DataFrame:
    """Without the candidates inside a longer one that occurs often enough."""
    size = F.size("words")
    inner = candidates.filter(size > 2).withColumn("size", F.explode(F.sequence(F.lit(2), size - 1))).withColumn(
        "first", F.explode(F.sequence(F.lit(1), size - F.col("size") + 1))).select(
        F.slice("words", F.col("first"), F.col("size")).alias("words"), "f")
    covers = inner.groupBy("words").agg(F.max("f").alias("longer"))
    return scored.join(covers, "words", "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))).drop("longer")


COLLOCATION_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM g GROUP BY lang, size, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(p[:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y
  FROM cand, (VALUES (1), (2)) AS c(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, f, array_to_string(p[:2], ' ') AS phrase FROM cand WHERE size = 3
  UNION ALL SELECT lang, f, array_to_string(p[2:], ' ') FROM cand WHERE size = 3),
covers AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY lang, phrase),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r,
    n.n::BIGINT AS n, score::BIGINT AS score
  FROM best b JOIN n ON n.lang = b.lang LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.longer IS NULL OR 100 * c.longer < 50 * a)
SELECT * FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATION_SQL)
def _collocations(spark, folder):
    return collocations(table(spark, folder, "documents"))
