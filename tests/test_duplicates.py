"""Duplicates by fingerprint, key ranges and samples that do not grow with the partitions."""

import random

from pyspark.sql import functions as F

from veritab.functions.ranking import hashed_sample, running_totals
from veritab.operators import quality


def shuffled_bytes(spark, action):
    before = {s.stageId() for s in _stages(spark)}
    action()
    return sum(s.shuffleWriteBytes() for s in _stages(spark) if s.stageId() not in before)


def _stages(spark):
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    listed = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return [listed.apply(i) for i in range(listed.size())]


def test_duplicates_against_plain_counting(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, -1]), rng.choice([None, "", "a", "b"]), rng.choice([None, 0.0, -0.0, 2.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a int, b string, c double").repartition(4)
    groups = {}
    for k, *cells in rows:
        groups.setdefault(tuple(0.0 if x == 0 and isinstance(x, float) else x for x in cells), []).append(k)

    def check():
        row = quality.duplicate_summary(df, ["a", "b", "c"]).first()
        assert (row["total_rows"], row["duplicate_rows"], row["unique_rows"], row["duplicate_groups"]) == (
            300, 300 - len(groups), len(groups), sum(len(g) > 1 for g in groups.values()))
        want = sorted(k for g in groups.values() for k in sorted(g)[1:])[:40]
        assert [r["k"] for r in quality.duplicate_keys(df, "k", ["a", "b", "c"], 40).collect()] == want

    check()
    # Fingerprints that all rows share leave the comparison of whole rows.
    monkeypatch.setattr(quality, "_fingerprints", lambda df, columns: [F.lit(7).alias(n) for n in quality._PRINTS])
    check()


def test_no_rows_and_no_columns(spark):
    empty = quality.duplicate_summary(spark.createDataFrame([], "a int")).first()
    assert (empty["total_rows"], empty["duplicate_rows"], empty["has_duplicates"]) == (0, 0, False)
    row = quality.duplicate_summary(spark.range(5), []).first()
    assert (row["total_rows"], row["duplicate_rows"], row["unique_rows"]) == (5, 4, 1)


def test_only_fingerprints_of_all_rows_are_shuffled(spark):
    wide = spark.range(20000).repartition(4).select(
        *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256).alias(f"c{i}") for i in range(8)])
    wide = wide.unionAll(wide.limit(20)).persist()
    wide.count()
    whole = shuffled_bytes(spark, lambda: wide.groupBy(*wide.columns).count().agg(F.sum("count")).collect())
    found = []
    prints = shuffled_bytes(spark, lambda: found.append(quality.duplicate_summary(wide).first()))
    wide.unpersist()
    assert found[0]["duplicate_rows"] == 20
    assert prints * 5 <= whole


def test_the_driver_gets_a_sample_of_one_size(spark):
    for parts in (8, 400):
        df = spark.range(100_000).repartition(parts)
        plan = hashed_sample(df, F.col("id"), 64, 100_000)
        assert plan.count() == 64
        kept = df.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int((2 * 64 + 100) / 100_000 * (1 << 40)) + 1)).count()
        assert 64 <= kept < 400
    assert hashed_sample(spark.range(10), F.col("id"), 64, 10).count() == 10


def test_totals_over_ranges_of_hot_and_clashing_columns(spark):
    df = spark.range(500).select(F.col("id").alias("v"), F.lit(2).alias("w"), F.lit("x").alias("_range")).repartition(7)
    for descending in (False, True):
        got = running_totals(df, "v", {"t": "w"}, descending, bucket_rows=30).collect()
        assert all(r["t"] == 2 * ((500 - r["v"]) if descending else (r["v"] + 1)) and r["_range"] == "x" for r in got)
