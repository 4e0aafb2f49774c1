"""A corpus pipeline of the operators in ``veritab.llm``: each stage is stored and read again before the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the
last return the columns of ``documents``. Tables a stage has written for itself
are deleted when the next one starts, after its result is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, table
from veritab.llm.decontamination import decontaminated
from veritab.llm.near_dedup import near_duplicates
from veritab.llm.passages import without_passages
from veritab.llm.pieces import encoded_digests
from veritab.llm.quality import good_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    Scratch.close_all()
    return good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Rows without a doc_id stay; of rows that repeat an id one stays, the one with the smallest text.
    """
    Scratch.close_all()
    found = near_duplicates(docs, shingle=5, percent=80)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    kept = docs.join(dropped, docs["doc_id"] == F.col("_dropped"), "left_anti")
    repeated = docs.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1 AND _id IS NOT NULL").select("_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == F.col("_id"), "left_anti")
    again = kept.join(repeated, kept["doc_id"] == F.col("_id"), "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row"))
    return once.unionByName(again.select(
        *[F.col("doc_id") if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in docs.columns]))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document holds."""
    Scratch.close_all()
    return without_passages(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    Scratch.close_all()
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    Scratch.close_all()
    return encoded_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", cut_passages),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    kept = Scratch(spark)
    Scratch._open.remove(kept)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stored = kept.write(stage(spark, docs, sf_dir))
        if number:
            kept.drop(docs)
        docs = stored
    Scratch.close_all()
    return docs


@query("pipeline", ORACLE_SQL)
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
