"""Benchmark decontamination with built-in functions only: size-partitioned MinHash containment search.

A test item is found in a document when enough of its word shingles occur there
(containment). Shingles of documents that no item has cannot count, so they are
dropped first; what is left of a document, its foreign set, is small even in a
very long text. Foreign sets are partitioned by size (Zhu, Nargesian, Pu and
Miller, LSH Ensemble, 2016): within a partition the size bound turns the wanted
containment into a Jaccard similarity, and that into the number of MinHash values
of which at least one must agree. A partition so far above an item's size that
it would need more than ``MAX_HASHES`` values is searched by the shingles
themselves. Every candidate is verified by exact containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, sized, table

MAX_HASHES = 256
MISS = 1e-6


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _grams(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, none in a shorter text."""
    w = F.col(words)
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[F.get(w, i + j) for j in range(size)]))


def hashes_needed(items: Column, upper: Column, percent: int) -> Column:
    """MinHash values after which a set of ``upper`` elements holding ``percent`` of an item is missed once in a million."""
    shared = items * (percent / 100)
    jaccard = shared / (upper + items - shared)
    return F.when(jaccard >= 1, 1).otherwise(F.ceil(math.log(MISS) / F.log1p(-jaccard))).cast("int")


def contained_items(documents: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: documents that hold at least ``percent`` of an item's shingles.

    Words are runs of letters and digits, lower-cased; shingles are runs of
    ``shingle`` words; an item with fewer words is one run as a whole, looked for
    as such. Items and documents that are NULL, empty or without words match
    nothing; rows without an id take no part. Rows that share an id count as one
    document or item. Other columns are ignored; empty tables give no rows.
    """
    scratch = Scratch(documents.sparkSession)
    listed = items.select(items["item_id"].alias("item_id"), items["text"].cast("string").alias("_text")).filter(
        F.col("item_id").isNotNull()).withColumn("_w", _words("_text")).filter(F.size("_w") > 0)
    lengths = sorted(r[0] for r in listed.select(F.least(F.size("_w"), F.lit(shingle))).distinct().collect())
    whole = F.lit(None)
    for n in lengths:
        fits = F.size("_w") >= shingle if n == shingle else F.size("_w") == n
        whole = F.when(fits, _grams("_w", n)).otherwise(whole)
    if not lengths:
        whole = F.array().cast("array<bigint>")
    item_sets = scratch.write(
        listed.select("item_id", F.explode(whole).alias("h")).groupBy("item_id").agg(F.collect_set("h").alias("q")))
    item_grams = scratch.write(item_sets.select("item_id", F.size("q").alias("n_item"), F.explode("q").alias("h")))
    vocabulary = scratch.write(item_grams.select("h").distinct())
    n_items, n_grams, n_words = item_sets.count(), item_grams.count(), vocabulary.count()

    texts = documents.select(documents["doc_id"].cast("long").alias("doc_id"),
                             documents["text"].cast("string").alias("_text"))
    grams = texts.filter("doc_id IS NOT NULL").select("doc_id", _words("_text").alias("_w")).select(
        "doc_id", F.explode(F.concat(*[_grams("_w", n) for n in lengths] or [F.array().cast("array<bigint>")]))
        .alias("h"))
    foreign = scratch.write(
        grams.join(sized(vocabulary, n_words), "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("x"))
        .withColumn("part", F.ceil(F.log2(F.size("x").cast("double"))).cast("int")))

    parts = sorted(r[0] for r in foreign.select("part").distinct().collect())  # at most one per power of two
    part_list = F.array(*[F.lit(p) for p in parts]).cast("array<int>")
    upper = F.pow(F.lit(2.0), F.col("part"))
    reach = (
        item_sets.withColumn("n_item", F.size("q")).withColumn("part", F.explode(part_list))
        .filter(upper * 100 >= F.col("n_item") * percent)
        .withColumn("hashes", hashes_needed(F.col("n_item"), upper, percent)))
    by_hash = reach.filter(F.col("hashes") <= MAX_HASHES)
    direct = reach.filter(F.col("hashes") > MAX_HASHES).select("item_id", "part")
    most = {r[0]: r[1] for r in by_hash.groupBy("part").agg(F.max("hashes")).collect()}
    document_hashes = F.lit(0)
    for p, n in most.items():
        document_hashes = F.when(F.col("part") == p, n).otherwise(document_hashes)

    def keyed(df: DataFrame, elements: str) -> DataFrame:
        values = F.transform(F.sequence(F.lit(1), F.col("hashes")), lambda i: F.xxhash64(
            F.col("part"), i, F.array_min(F.transform(F.col(elements), lambda x: F.xxhash64(x, i)))))
        return df.withColumn("key", F.explode(values)).drop("hashes", "part", elements)

    item_keys = keyed(by_hash.select("item_id", "q", "part", "hashes"), "q")
    document_keys = keyed(foreign.withColumn("hashes", document_hashes).filter("hashes > 0"), "x")
    n_keys = n_items * max([1, *most.values()]) * max(1, len(parts))
    candidates = document_keys.join(sized(item_keys, n_keys), "key").select("doc_id", "item_id").distinct()
    near = candidates.join(foreign.select("doc_id", "x"), "doc_id").join(sized(item_sets, n_grams), "item_id").select(
        "doc_id", "item_id", F.size(F.array_intersect("x", "q")).cast("long").alias("n_shared"),
        F.size("q").cast("long").alias("n_item"))
    far = (
        foreign.select("doc_id", "part", F.explode("x").alias("h")).join(sized(item_grams, n_grams), "h")
        .join(sized(direct, n_items * max(1, len(parts))), ["part", "item_id"])
        .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"),
                                          F.first("n_item").cast("long").alias("n_item")))
    return near.unionByName(far).filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def decontaminated(documents: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that hold none of the items, with all their columns."""
    found = contained_items(documents, items, shingle, percent).select(F.col("doc_id").alias("_found")).distinct()
    return documents.join(found, documents["doc_id"] == found["_found"], "left_anti")


_SQL_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

CONTAINED_SQL = f"""
WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM i),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2),
        lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
       FROM d, (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0) WHERE len(w) >= n),
q AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM dg JOIN ig USING (g) JOIN q USING (item_id) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_item) * 80
"""


@query("op4_contained_items", CONTAINED_SQL)
def _contained_items(spark, folder):
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
