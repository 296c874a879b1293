"""Sliding and grouped quantiles against sorting."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.operators import quantiles as Q


@pytest.mark.parametrize("before, after, block", [(399, 0, 8192), (5, 3, 16), (31, 31, 100), (0, 0, 4), (0, 9, 10), (50, 0, 7)])
def test_sliding_equals_sorting_each_window(spark, before, after, block):
    r = np.random.default_rng(5)
    held = {k: [None if r.random() < 0.1 else float(np.round(v, 1)) for v in r.uniform(0, 9, n)] for k, n in {"a": 1, "b": 40, "c": 700}.items()}
    held["d"] = [None, float("nan"), 3.0]
    rows = [(k, i, x) for k, v in held.items() for i, x in enumerate(v)]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "id string, idx bigint, x double").repartition(3)
    got = {(x["id"], x["idx"]): x["q"] for x in Q.sliding(df, F.col("x"), (0.5, 0.95), before, after, block).collect()}
    assert len(got) == len(rows)
    for k, v in held.items():
        for i in range(len(v)):
            w = [x for x in v[max(i - before, 0) : i + after + 1] if x is not None and x == x]
            want = [None, None] if not w else np.quantile(w, (0.5, 0.95))
            assert got[k, i] == (want if w == [] else pytest.approx(list(want)))


def test_cost_of_a_row_does_not_follow_the_width():
    x = np.random.default_rng(1).random(60_000).tolist()

    def took(width: int) -> float:
        s, began = Q.Sorted(), 0.0
        for k, v in enumerate(x[: width + 20_000]):
            if k == width:
                began = time.perf_counter()
            s.add(v)
            if k >= width:
                s.remove(x[k - width])
                s.quantile(0.5)
        return time.perf_counter() - began

    assert took(32_000) < 8 * took(100)


def test_sorted_blocks_equal_a_sorted_list():
    r = np.random.default_rng(2)
    s, held = Q.Sorted(), []
    for _ in range(6000):
        if held and r.random() < 0.4:
            s.remove(held.pop(int(r.integers(len(held)))))
        else:
            held.append(float(r.integers(0, 300)))
            s.add(held[-1])
    assert [s.at(k) for k in range(len(held))] == sorted(held) and s.n == len(held) and max(map(len, s.blocks)) <= 2 * Q.LOAD


@pytest.mark.parametrize("limit, pivots", [(100_000, 64), (500, 8), (20, 3), (1, 2)])
def test_groups_of_any_size(spark, limit, pivots):
    r = np.random.default_rng(6)
    held = {"heavy": (r.pareto(0.3, 4000) * 1e9), "ties": r.integers(0, 3, 2500).astype(float), "same": np.full(900, 7.0), "few": r.normal(size=11), "one": np.array([5.0]), None: r.normal(size=1500), "wide": np.concatenate([-(10.0 ** r.uniform(-300, 300, 700)), 10.0 ** r.uniform(-300, 300, 700)])}
    rows = [(k, float(x)) for k, v in held.items() for x in v] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    qs = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {x["k"]: x["q"] for x in Q.grouped(df, "k", F.col("x"), qs, limit, pivots).collect()}
    assert set(got) == set(held)
    for k, v in held.items():
        assert got[k] == pytest.approx(np.quantile(v, qs).tolist(), rel=1e-12), k


def test_empty(spark):
    none = spark.createDataFrame([], "id string, idx bigint, x double")
    assert Q.sliding(none, F.col("x"), (0.5,), 3).count() == 0 and Q.grouped(none, "id", F.col("x"), (0.5,)).count() == 0
