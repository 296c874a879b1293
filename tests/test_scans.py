"""Scans over blocks against one loop over a signal, and how the work is dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.operators import recursive, scans
from tidesmith.streaming.sessions import Segmenter


def signals(spark, sizes, seed=1):
    r = np.random.default_rng(seed)
    held = {f"s{k}": r.uniform(0, 100, n) for k, n in enumerate(sizes)}
    rows = [(k, i, float(x)) for k, v in held.items() for i, x in enumerate(v)]
    order = r.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "id string, idx bigint, x double").repartition(4), held


def by_id(df, *columns):
    out = {}
    for r in df.orderBy("id", "idx").collect():
        out.setdefault(r["id"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


SIZES = [1, 2, 7, 8, 9, 64, 150, 700]


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_gate_and_level_equal_a_loop(spark, block):
    sig, held = signals(spark, SIZES)
    attack, release = recursive.gate_coefficients()
    gates = by_id(scans.gate(sig, F.col("x") > 50, block=block), "gate")
    levels = by_id(scans.level(sig, F.col("x") - 60, least_db=-20.0, block=block), "level")
    for k, v in held.items():
        g, level, want_g, want_l = 1.0, None, [], []
        for x in v:
            target = 1.0 if x > 50 else 0.1
            a = attack if target > g else release
            g = a * g + (1 - a) * target
            if x - 60 > -20:
                level = x - 60 if level is None else 0.92 * level + 0.08 * (x - 60)
            want_g.append(g)
            want_l.append(level)
        assert np.allclose(gates[k], want_g, atol=1e-12)
        assert [x is None for x in levels[k]] == [x is None for x in want_l] and np.allclose([x for x in levels[k] if x is not None], [x for x in want_l if x is not None])


@pytest.mark.parametrize("block", [5, 4096])
def test_noise_floor_equals_a_loop(spark, block):
    sig, held = signals(spark, SIZES, 2)
    got = by_id(scans.noise(sig.select("id", "idx", F.col("x").alias("power"), (F.col("x") * 3).alias("smooth"), (100 - F.col("x")).alias("floor")), block=block), "p", "noise")
    for k, v in held.items():
        want = []
        for i, x in enumerate(v):
            if not i:
                p, noise = 0.0, x
            else:
                p = 0.2 * p + 0.8 * (3 * x / max(100 - x, 1e-12) > 5)
                a = 0.95 + 0.05 * p
                noise = a * noise + (1 - a) * x
            want.append((p, noise))
        assert np.allclose(got[k], want)


def test_noise_of_nothing_is_minus_infinity(spark, tmp_path):
    """A first value of 0 makes a floor of 0, whose level the SQL has as -infinity; the same for the ratio of a constant reference."""
    from tidesmith.operators import scoring
    from tidesmith.plans import recursions

    spark.sql("SELECT id AS event_id, timestamp_seconds(id) AS ts, 1L AS user_id, IF(id < 2, 0D, 8D) AS value FROM range(4)").write.parquet(str(tmp_path / "events.parquet"))
    rows = recursions.noise_floor(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["noise_db"] for r in rows[:2]] == [-np.inf, -np.inf] and abs(rows[3]["noise_db"]) < np.inf
    pairs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "id string, ref double, est double")
    assert scoring.measured_snr(pairs).first()["snr"] == -np.inf


@pytest.mark.parametrize("block, onset, hang", [(4, 2, 12), (9, 3, 2), (4096, 2, 12), (7, 1, 0)])
def test_hysteresis_equals_a_loop(spark, block, onset, hang):
    sig, held = signals(spark, SIZES, 3)
    got = by_id(scans.hysteresis(sig, F.col("x") > 60, onset, hang, block), "hang", "active")
    for k, v in held.items():
        run, left, active, want = 0, 0, False, []
        for x in v:
            if x > 60:
                run += 1
                if run >= onset:
                    left, active = hang, True
            else:
                run = 0
                if left > 0:
                    left -= 1
                else:
                    active = False
            want.append((left, active))
        assert got[k] == want


@pytest.mark.parametrize("quiet, least, longest, block", [(2, 3, 20, 4096), (2, 3, 20, 22), (30, 38, 750, 4096), (1, 1, 3, 5), (3, 2, 9, 11), (4, 1, 6, 8)])
def test_segments_equal_the_state_machine(spark, quiet, least, longest, block):
    r = np.random.default_rng(4)
    held = {k: np.repeat(r.random(n) < p, r.integers(1, 12, n)) for k, (n, p) in enumerate([(1, 1), (1, 0), (3, 0.5), (60, 0.3), (400, 0.5), (900, 0.05), (900, 0.9), (40, 1.0)])}
    rows = [(k, i, bool(x)) for k, v in held.items() for i, x in enumerate(v)]
    frames = spark.createDataFrame(rows, "id int, idx bigint, speech boolean").repartition(3)
    got = sorted(tuple(x) for x in scans.segments(frames, quiet, least, longest, block).collect())
    want = []
    for k, v in held.items():
        m = Segmenter(quiet, least, longest)
        want += [(k, *c) for x in v if (c := m.step(bool(x))) is not None]
    assert got == sorted(want)


def test_nulls_ties_gaps_empty_tables(spark):
    rows = [(None, 0, 80.0), (None, 1, None), ("a", 0, 10.0), ("a", 5, 90.0), ("a", 5, 90.0), ("b", 0, None)]
    sig = spark.createDataFrame(rows, "id string, idx bigint, x double").withColumn("block", F.lit(1)).withColumn("m", F.lit(2)).withColumn("a.b", F.lit(3))
    assert scans.gate(sig, F.col("x") > 50, block=2).count() == 6 and scans.hysteresis(sig, F.col("x") > 50, block=2).count() == 6
    assert [x["level"] for x in scans.level(sig, F.col("x"), least_db=50, block=2).orderBy("id", "idx").collect()] == [80.0, 80.0, None, 90.0, 90.0, None]
    none = sig.limit(0)
    assert scans.gate(none, F.col("x") > 50).count() == 0 and scans.segments(none.select("id", "idx", (F.col("x") > 1).alias("speech"))).count() == 0
    assert scans.segments(sig.select("id", "idx", F.lit(None).cast("boolean").alias("speech"))).count() == 0


def test_one_signal_is_many_tasks_work(spark):
    """400,000 frames of one id: states as in one loop, and no row of the plan holds more than a block."""
    n = 400_000
    sig = spark.range(n).select(F.lit(7).alias("id"), F.col("id").alias("idx"), (F.xxhash64("id") % 3 == 0).alias("speech"))
    out = scans.gate(sig, F.col("speech"))
    assert scans.packed(sig, F.lit(1)).agg(F.max(F.size("v"))).first()[0] == scans.BLOCK
    flags = np.array([x["speech"] for x in sig.orderBy("idx").collect()])
    attack, release = recursive.gate_coefficients()
    g, at = 1.0, {}
    for i, x in enumerate(flags):
        target = 1.0 if x else 0.1
        a = attack if x else release
        g = a * g + (1 - a) * target
        at[i] = g
    picked = {x["idx"]: x["gate"] for x in out.filter("idx % 9973 = 0 OR idx = 399999").collect()}
    assert len(picked) > 40 and all(abs(at[i] - v) < 1e-9 for i, v in picked.items())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) == 4 and max(x["count"] for x in tasks) < n / 2
