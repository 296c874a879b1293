"""Streams over several micro-batches, out of order, against the batch."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.kernels.spectral import Framing
from tidesmith.streaming import reorder, sessions

FRAMING = Framing(64, 32)


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reorder.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def chunks(seed=2, n=900):
    rng, rows = np.random.default_rng(seed), []
    for s in ("a", "b", "c"):
        x, seq, at = rng.uniform(-0.5, 0.5, n), 0, 0
        while at < len(x):
            k = int(rng.integers(1, 90))
            rows.append((s, seq, [float(v) for v in np.float32(x[at : at + k])], json.dumps({"method": "wiener"}) if seq in (0, 5) else None))
            at, seq = at + k, seq + 1
    return rows, rng


def feed(spark, path, rows, schema=sessions.CHUNKS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def wait_for(spark, name, n, seconds=90):
    """Until the sink has n rows. A stream with processing-time timers runs batches for ever, so it is never done."""
    until = time.time() + seconds
    while spark.table(name).count() < n and time.time() < until:
        time.sleep(0.2)


def started(df, name, tmp_path):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()


def test_any_order_gives_the_batch_samples(store, tmp_path):
    spark, path = store, str(tmp_path / "in")
    rows, rng = chunks()
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    batch = sessions.enhance_stream(spark.createDataFrame(rows, sessions.CHUNKS), FRAMING)
    feed(spark, path, shuffled[:20])
    q = started(reorder.ordered_stream(sessions.replay(spark, path), FRAMING, wait_ms=10**9, idle_ms=2 * 10**9), "ordered", tmp_path)
    try:
        for at in range(20, len(shuffled), 20):
            feed(spark, path, shuffled[at : at + 20] + shuffled[at - 3 : at])  # some come twice
        wait_for(spark, "ordered", 3 * (900 // 32))
    finally:
        q.stop()
    key = lambda r: (r["session"], r["block"])
    got, want = sorted(spark.table("ordered").collect(), key=key), sorted(batch.collect(), key=key)
    assert len(got) == len(want) == 3 * (900 // 32) and max(r["late"] for r in got) > 0 and all(r["lost"] == 0 for r in got)
    assert all(np.array_equal(g["samples"], w["samples"]) and g["block"] == w["block"] for g, w in zip(got, want))


def test_a_gap_is_given_up_by_a_timer_or_a_full_buffer(store, tmp_path):
    spark = store
    rows = [("a", k, [0.1] * 32, None) for k in range(12)]
    for name, wait, most in (("timer", 300, 256), ("full", 10**9, 3)):
        path = str(tmp_path / name)
        feed(spark, path, rows[:2] + rows[4:10])
        q = started(reorder.ordered_stream(sessions.replay(spark, path), FRAMING, wait_ms=wait, idle_ms=2 * 10**9, most_waiting=most), name, tmp_path)
        try:
            wait_for(spark, name, 8)
            feed(spark, path, rows[2:4] + rows[10:])  # too late, and in time
            wait_for(spark, name, 10)
        finally:
            q.stop()
        out = spark.table(name).orderBy("block").collect()
        assert len(out) == 10 and out[-1]["lost"] == 2 and out[-1]["late"] == 2 and out[1]["lost"] == 0, name


def test_an_open_segment_is_given_out_on_time_out(store, tmp_path):
    spark, path = store, str(tmp_path / "s")
    schema = "session string, t bigint, is_speech boolean"
    flags = {"a": [0, 1, 1, 0, 0, 0, 1], "b": [0] * 5, "c": [1]}
    feed(spark, path, [(s, t, bool(x)) for s, v in flags.items() for t, x in enumerate(v)], schema)
    q = started(reorder.closing_segments(sessions.replay(spark, path, schema), 3, 2, 10, idle_ms=500), "cut", tmp_path)
    try:
        wait_for(spark, "cut", 3)
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("cut").collect()) == [("a", 1, 6), ("a", 6, 7), ("c", 0, 1)]
