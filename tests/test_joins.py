"""Interval joins, long convolutions, noise filters and index folders against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.operators import benchmark, convolution, evaluation
from tidesmith.sources import records


def test_intervals_of_any_length(spark):
    r = np.random.default_rng(8)
    values = [(i, float(x)) for i, x in enumerate(np.concatenate([r.normal(0, 100, 300), [0.0, 5.0, -5.0]]))] + [(900, None), (901, float("nan")), (1, 5.0)]
    spans = [(float(a), float(a + 10.0 ** r.uniform(-6, 4))) for a in r.normal(0, 100, 200)] + [(0.0, 5.0), (5.0, 5.0), (9.0, 1.0), (None, -50.0), (80.0, None), (None, None), (0.0, 5.0), (-5.0, 0.0), (float("nan"), 1.0), (1e9, 2e9)]
    v = spark.createDataFrame(values, "k int, x double").repartition(3)
    s = spark.createDataFrame([(j, *e) for j, e in enumerate(spans)], "j int, low double, high double").repartition(2)
    got = sorted((x["k"], x["j"]) for x in evaluation.interval_join(v, "x", s).collect())
    holds = lambda x, a, z: (a is None or x >= a) and (z is None or x < z)
    want = sorted((k, j) for k, x in values if x is not None and x == x for j, (a, z) in enumerate(spans) if holds(x, a, z) and (a is None or a == a))
    assert got == want and len(got) > 3000


@pytest.mark.parametrize("top", [0, 3, 12])
def test_interval_summary_equals_the_join(spark, top):
    r = np.random.default_rng(8)
    values = [(i, float(x)) for i, x in enumerate(np.concatenate([r.normal(0, 100, 300), [0.0, -0.0, 5.0, -5.0, 1e9]]))] + [(900, None), (901, float("nan")), (1, 5.0), (1, 5.0)]
    spans = [(float(a), float(a + 10.0 ** r.uniform(-6, 4))) for a in r.normal(0, 100, 200)] + [(0.0, 5.0), (5.0, 5.0), (9.0, 1.0), (None, -50.0), (80.0, None), (None, None), (0.0, 5.0), (-5.0, 0.0), (float("nan"), 1.0), (1e9, 2e9)]
    v = spark.createDataFrame(values, "k int, x double").repartition(3)
    s = spark.createDataFrame([(j, *e) for j, e in enumerate(spans)], "j int, low double, high double").repartition(2)
    want = evaluation.interval_join(v.distinct(), "x", s).groupBy("k", "x").agg(F.count("j").alias("n"), F.min("j").alias("least"))
    key = lambda d: sorted((x["k"], x["x"], x["n"], x["least"]) for x in d.collect())
    assert key(evaluation.interval_summary(v.distinct(), "x", s, "j", top=top)) == key(want)
    assert evaluation.interval_summary(v, "x", s, "j").filter("k = 1 AND x = 5").count() == 2
    assert evaluation.interval_summary(v.limit(0), "x", s, "j").count() == 0 and evaluation.interval_summary(v, "x", s.limit(0), "j").count() == 0


def test_interval_summary_makes_no_pairs(spark):
    """Ten thousand million pairs."""
    v = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 1000 * 1.0).alias("x"))
    s = spark.range(100_000).select(F.col("id").alias("j"), F.lit(0.0).alias("low"), (F.col("id") + 1000.0).alias("high"))
    out = evaluation.interval_summary(v, "x", s, "j").agg(F.sum("n"), F.max("least"), F.count("k")).first()
    assert tuple(out) == (10**10, 0, 10**5)


def test_a_hundred_thousand_intervals_are_no_nested_loop(spark):
    s = spark.range(100_000).select(F.col("id").alias("j"), (F.col("id") * 1.5).alias("low"), (F.col("id") * 1.5 + 1 + F.col("id") % 7).alias("high"))
    v = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 3.1).alias("x"))
    out = evaluation.interval_join(v, "x", s)
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    x, low = np.arange(50_000) * 3.1, np.arange(100_000) * 1.5
    high = low + 1 + np.arange(100_000) % 7
    assert out.count() == sum(int(((low[max(k - 8, 0) : k] <= p) & (high[max(k - 8, 0) : k] > p)).sum()) for p, k in zip(x, np.searchsorted(low, x, "right")))


def test_empty_sides(spark):
    v, s = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(1, 0.0, 9.0)], "j int, low double, high double")
    assert evaluation.interval_join(v, "x", s).count() == 1
    assert evaluation.interval_join(v.limit(0), "x", s).count() == 0 and evaluation.interval_join(v, "x", s.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_long_responses_equal_direct_sums(spark, block):
    r = np.random.default_rng(9)
    x = {"a": r.normal(size=1), "b": r.normal(size=130), None: r.normal(size=64), "c": r.normal(size=9), "d": r.normal(size=5)}
    h = {"a": r.normal(size=50), "b": r.normal(size=300), None: r.normal(size=3), "c": r.normal(size=1)}
    df = lambda d, n: spark.createDataFrame([(k, i, float(v)) for k, vs in d.items() for i, v in enumerate(vs)], f"id string, idx bigint, {n} double").repartition(3)
    out = {}
    for row in convolution.convolve(df(x, "x"), df(h, "h"), block).orderBy("idx").collect():
        out.setdefault(row["id"], []).append((row["idx"], row["y"]))
    assert set(out) == set(h)
    for k in h:
        assert [i for i, _ in out[k]] == list(range(len(x[k]))) and np.allclose([y for _, y in out[k]], np.convolve(x[k], h[k])[: len(x[k])])


def test_one_response_for_all_signals(spark):
    r = np.random.default_rng(10)
    x, h = {"a": r.normal(size=1), None: r.normal(size=70), "c": r.normal(size=9)}, r.normal(size=500)
    sig = spark.createDataFrame([(k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)], "id string, idx bigint, x double").repartition(3)
    taps = spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "idx bigint, h double")
    out = {}
    for row in convolution.convolve(sig, taps, 16).orderBy("idx").collect():
        out.setdefault(row["id"], []).append(row["y"])
    assert set(out) == set(x) and all(np.allclose(out[k], np.convolve(x[k], h)[: len(x[k])]) for k in x)


def test_convolution_of_odd_rows(spark):
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("a", 5, None), ("a", 9, 3.0)], "id string, idx bigint, x double").withColumn("k", F.lit(1)).withColumn("block", F.lit(2))
    h = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 10.0)], "id string, idx bigint, h double")
    got = [round(r["y"], 9) for r in convolution.convolve(x, h, 4).orderBy("idx").collect()]
    assert got == [2, 0, 20, 0, 0, 0, 0, 0, 0, 3]
    assert convolution.convolve(x.limit(0), h).count() == 0 and convolution.convolve(x, h.limit(0)).count() == 0


def test_usable_noise(spark):
    r = np.random.default_rng(1)
    rows = [(1, r.normal(size=300_000).tolist()), (2, [0.5] * 20_000), (3, r.normal(size=2000).tolist()), (4, [*r.normal(size=9000).tolist(), float("nan")]), (5, []), (6, None), (7, [0.0] * 160_000 + r.normal(size=9000).tolist()), (8, (5 + r.normal(size=7936)).tolist())]
    out = {x["id"]: x for x in benchmark.usable_noise(spark.createDataFrame(rows, "id int, samples array<double>")).collect()}
    assert set(out) == {1, 8} and len(out[1]["samples"]) == 160_000 and abs(np.mean(out[8]["samples"])) < 1e-9 and out[8]["n_frames"] == 32


def test_index_folder_of_many_parts(spark, tmp_path):
    df = spark.range(5000).select(F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 2 == 0, "t").alias("text"), F.lit(5).alias("snr")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records.write_index(df, benchmark.envelope(df, "set", "test", ["snr"], True), str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "i" / "records").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 1 and len(lines) == 5000 and lines == sorted(lines)
    head, rows = records.read_index(spark, str(tmp_path / "i"))
    assert head["dataset_id"] == "set" and rows.count() == 5000 and rows.filter("text IS NULL").count() == 2500
    (tmp_path / "one.json").write_text('{"dataset_id": "d", "strata": ["snr"], "records": [{"id": "1", "snr": 5}]}')
    assert records.read_index(spark, str(tmp_path / "one.json"))[1].collect()[0]["snr"] == 5
