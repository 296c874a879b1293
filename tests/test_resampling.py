"""Bootstrap intervals: numpy's numbers for any number of tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.operators import evaluation, resampling


@pytest.mark.parametrize("n", [2, 3, 30, 1000, 70_001])
def test_chunks_of_the_stream_are_numpys_draws(n):
    want = np.random.default_rng(7).integers(0, n, 5000)
    for draws in (2, 64, 1000):
        got = np.concatenate([resampling.accepted(7, n, c, draws) for c in range(5000 // draws + 2)])
        assert np.array_equal(got[:5000], want)


def test_draws_that_are_not_accepted_shift_the_rest():
    n = 3_000_000_019  # most of 2^32: a good share of raw numbers is rejected
    want = np.random.default_rng(3).integers(0, n, 3000)
    parts = [resampling.accepted(3, n, c, 100) for c in range(60)]
    assert min(map(len, parts)) < 90 and np.array_equal(np.concatenate(parts)[:3000], want)


@pytest.mark.parametrize("draws, block, parts", [(1 << 18, 1 << 20, 3), (50, 7, 5), (2, 1000, 1)])
def test_intervals_equal_one_stream(spark, draws, block, parts):
    r = np.random.default_rng(0)
    held = {"m": r.normal(size=30), "big": r.normal(5, 2, size=61), "one": np.array([2.5]), None: r.normal(size=8)}
    rows = [(g, i, float(v)) for g, x in held.items() for i, v in enumerate(x)] + [("m", 99, None), ("m", 98, float("nan")), ("m", 97, float("inf")), ("none", 0, None)]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "g string, i int, v double").repartition(parts)
    out = {x["g"]: x for x in resampling.bootstrap(df, "g", "v", "i", 60, draws=draws, block=block).collect()}
    assert set(out) == {*held, "none"} and tuple(out["none"])[1:] == (0, None, None, None)
    for g, x in held.items():
        means = x[np.random.default_rng(resampling.SEED).integers(0, len(x), size=(60, len(x)))].mean(axis=1)
        assert out[g]["n"] == len(x) and (out[g]["mean"], out[g]["low"], out[g]["high"]) == pytest.approx((x.mean(), *np.quantile(means, (0.025, 0.975))), rel=1e-12)


def test_hashed_weights_cover_as_often(spark):
    x = np.random.default_rng(0).normal(size=30)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double")
    exact, hashed = resampling.bootstrap(df, "g", "v", "i").first(), evaluation.bootstrap_hashed(df, "g", "v", "i").first()
    assert abs(hashed["low"] - exact["low"]) < 0.15 and abs(hashed["high"] - exact["high"]) < 0.15


def test_an_empty_table(spark):
    assert resampling.bootstrap(spark.createDataFrame([], "g string, i int, v double"), "g", "v", "i").count() == 0


def test_a_large_group_is_many_tasks_work(spark):
    """200,000 values, 20 resamples: 4,000,000 draws in chunks; no block holds all values."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i"), ((F.col("id") * 7919) % 1000 / 10.0).alias("v"))
    out = resampling.bootstrap(df, "g", "v", "i", 20, block=1 << 16).first()
    x = np.arange(n) * 7919 % 1000 / 10.0
    means = x[np.random.default_rng(resampling.SEED).integers(0, n, size=(20, n))].mean(axis=1)
    assert (out["low"], out["high"]) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))), rel=1e-10)


def test_a_task_holds_a_slice_of_a_large_groups_draws():
    """A chunk of a group of ten million values has 160 million draws."""
    first = next(resampling.slices(7, 10_000_000, 3, 160_000_000))
    assert 0 < len(first) <= resampling.SLICE
    cut = np.concatenate(list(resampling.slices(7, 1000, 3, 5000, 64)))
    assert np.array_equal(cut, resampling.accepted(7, 1000, 3, 5000)) and [len(x) for x in resampling.slices(7, 1, 0, 10, 4)] == [4, 4, 2]
