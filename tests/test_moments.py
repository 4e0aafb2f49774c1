"""One-pass co-moments and radix selection against numpy and pandas."""

import resource

import numpy as np
import pandas as pd
import pytest

from veritab.functions.moments import batch_state, comoments, merged
from veritab.functions.quantiles import exact_quantiles, keys_of, value_of
from veritab.operators import correlation, profile
from veritab.schema import nan_to_null

PLACES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def frame_of(spark, table, parts=5):
    return nan_to_null(spark.createDataFrame(table)).repartition(parts)



def holes(rng, rows, columns):
    values = rng.normal(size=(rows, columns)) * 10.0 ** rng.integers(-3, 7, columns) + 10.0 ** rng.integers(0, 6, columns)
    values[:, 1] = values[:, 0] * 2 + rng.normal(size=rows)
    values[rng.random(values.shape) < 0.3] = np.nan
    return pd.DataFrame(values, columns=[f"c{i}" for i in range(columns)])


def test_pairwise_complete_correlations(spark):
    table = holes(np.random.default_rng(0), 3000, 12)
    table["fixed"] = 7.1
    table["empty"] = np.nan
    found = {(r["column_1"], r["column_2"]): r["correlation"]
             for r in correlation.correlation_matrix(frame_of(spark, table, 9)).collect()}
    want = table.corr()
    assert len(found) == 14 * 14
    for (a, b), r in found.items():
        if np.isnan(want.loc[a, b]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_constant_on_the_shared_rows_alone(spark):
    table = pd.DataFrame({"x": [0.1] * 50 + list(np.arange(50.0)), "y": list(np.arange(50.0)) + [np.nan] * 50})
    found = {(r["i"], r["j"]): r for r in comoments(frame_of(spark, table, 7), ["x", "y"]).collect()}
    assert found[0, 1]["n"] == 50 and found[0, 1]["dev_i"] == 0.0 and found[1, 0]["dev_j"] == 0.0
    assert found[0, 0]["n"] == 100 and found[0, 0]["dev_i"] > 0
    assert correlation.correlation_pairs(frame_of(spark, table, 7)).first()["correlation"] is None


def test_states_merge_to_the_state_of_all_rows():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(500, 6)) * 1e-3 + 1e6
    present = rng.random(values.shape) < 0.6
    present[:100, 2] = False

    def state(rows):
        return batch_state(np.where(present[rows], values[rows], 0.0), present[rows])

    whole = state(slice(0, 500))
    parts = merged(merged(state(slice(0, 100)), state(slice(100, 101))), state(slice(101, 500)))
    assert np.allclose(parts[0], whole[0]) and np.allclose(parts[1:3], whole[1:3], rtol=1e-15)
    assert np.allclose(parts[3:6], whole[3:6], rtol=1e-4, atol=1e-9)


def test_moments_of_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert [(r["n"], r["co"]) for r in comoments(empty, ["a", "b"]).collect()] == [(0, 0.0)] * 4
    assert [r["correlation"] for r in correlation.correlation_matrix(empty).collect()] == [None] * 4
    assert correlation.correlation_pairs(spark.createDataFrame([("x",)], "s string")).collect() == []


@pytest.mark.parametrize("columns", [9, 200])
def test_one_scan_whatever_the_width(spark, tmp_path, columns):
    holes(np.random.default_rng(2), 300, columns).to_parquet(tmp_path / "t.parquet")
    frame = nan_to_null(spark.read.parquet(str(tmp_path / "t.parquet")))
    found = correlation.correlation_matrix(frame)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1
    assert found.count() == columns * columns


def test_keys_order_like_numbers():
    values = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, np.inf])
    keys = keys_of(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert [value_of(int(k)) for k in keys] == values.tolist()


@pytest.mark.parametrize("buffer_rows", [1, 40, 2000])
def test_quantiles_of_awkward_columns(spark, buffer_rows):
    rng = np.random.default_rng(3)
    n = 6000
    table = pd.DataFrame({
        "normal": rng.normal(size=n), "small": rng.integers(-5, 5, n).astype(float),
        "wide": np.where(rng.random(n) < 0.5, np.nan, rng.lognormal(0, 30, n)), "zero": np.full(n, -0.0),
        "none": np.full(n, np.nan), "close": 1e9 + rng.random(n) * 1e-4, "hot": np.where(rng.random(n) < 0.4, 7.0, rng.random(n)),
        "one": [3.25] + [np.nan] * (n - 1)})
    got = exact_quantiles(frame_of(spark, table), list(table.columns), PLACES, buffer_rows)
    for c in table.columns:
        values = table[c].dropna()
        if not len(values):
            assert got[c] == [None] * len(PLACES)
        else:
            assert got[c] == pytest.approx([values.quantile(p) for p in PLACES], rel=1e-12, abs=1e-300)
    assert exact_quantiles(spark.createDataFrame([], "a double"), ["a"], PLACES) == {"a": [None] * len(PLACES)}


def test_profile_of_five_hundred_columns_stays_small(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(4000, 500))
    pd.DataFrame(values, columns=[f"c{i}" for i in range(500)]).to_parquet(tmp_path / "wide.parquet")
    frame = spark.read.parquet(str(tmp_path / "wide.parquet"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    quartiles = profile.quartile_arrays(frame, frame.columns)
    row = frame.limit(1).select(quartiles["c0"].alias("q")).first()
    assert list(row["q"]) == pytest.approx(np.quantile(values[:, 0], [0.25, 0.5, 0.75]))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 2 << 20
    assert (resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss) < 2 << 20
