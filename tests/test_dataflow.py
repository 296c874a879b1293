import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidesmith.kernels import synth
from tidesmith.kernels.spectral import Framing
from tidesmith.operators import benchmark, evaluation, kernels, recursive
from tidesmith.sources import audio, records
from tidesmith.streaming import sessions


def test_summary_pairs_with_the_baseline(spark):
    rows = [("a", "s", "none", 0.6), ("b", "s", "none", 0.4), ("a", "s", "specsub", 0.5), ("b", "s", "specsub", 0.3), ("c", "s", "specsub", float("nan"))]
    out = {r["method"]: r for r in evaluation.summary(spark.createDataFrame(rows, "id string, stratum string, method string, score double")).collect()}
    assert abs(out["specsub"]["mean"] - 0.4) < 1e-12 and abs(out["specsub"]["delta"] + 0.1) < 1e-12 and out["none"]["delta"] is None


def test_strata_must_be_declared(spark):
    df = spark.range(3)
    for bad in ([], ["id", "id"], "id", ["absent"]):
        with pytest.raises(ValueError):
            evaluation.check_strata(df, bad)
    cells = spark.createDataFrame([(c, i) for c in range(12) for i in range(3)], "c int, i int")
    assert evaluation.first_of_strata(cells, ["c"], ["i"], 2).count() == 24


def test_short_buckets_raise(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "b string, i int")
    with pytest.raises(Exception, match="too few rows"):
        evaluation.filled_buckets(df, "b", ["i"], 2).collect()


def test_split_keeps_groups_together(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 23)
    out = evaluation.split_by_group(df, F.col("g"))
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty() and out.filter("split = 'val'").select("g").distinct().count() == 2


def test_strata_grid(spark):
    assert benchmark.strata(spark).count() == 81 and benchmark.strata(spark, (0,)).count() == 17


def test_wave_files(spark, tmp_path):
    x = 0.5 * np.sin(np.arange(4000) / 10)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(audio.encode_wav(x)[0])
    (tmp_path / "in" / "b.wav").write_bytes(b"no audio")
    rows = {r["path"][-5:]: r for r in audio.read_audio(spark, str(tmp_path / "in")).collect()}
    assert np.abs(np.array(rows["a.wav"]["samples"]) - x).max() < 1e-4 and rows["b.wav"]["samples"] is None and rows["b.wav"]["error"]
    assert audio.encode_wav(2 * x)[1] == pytest.approx(1 / np.abs(2 * x).max()) and audio.wav_base64(x)
    assert [r["bytes"] for r in audio.manifest(spark, str(tmp_path / "in")).orderBy("bytes").collect()][0] == 8
    with pytest.raises(FileNotFoundError):
        audio.read_audio(spark, str(tmp_path / "in"), pattern="*.mp3")
    assert audio.scan(spark, str(tmp_path / "in")).count() == 2 and records.clips(spark, str(tmp_path / "in")).count() == 2


def test_embedded_audio(spark):
    good, short = audio.encode_wav(np.zeros(16_000 * 4))[0], audio.encode_wav(np.zeros(100))[0]
    df = spark.createDataFrame([(None, "x", good, "words enough"), ("p", "y", good, "few"), ("q", "z", short, "words enough"), ("r", "w", b"bad", "words enough")], "a string, b string, c binary, t string")
    assert [r["source_id"] for r in audio.embedded_audio(df, ["a", "b"], F.col("c"), F.col("t")).collect()] == ["x"]


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "数", 5), ("2", None, 6)], "id string, text string, snr int")
    head = benchmark.envelope(df, "set", "test", ["snr"], True)
    records.write_index(df, head, str(tmp_path / "i"))
    again, rows = records.read_index(spark, str(tmp_path / "i"))
    assert again["dataset_id"] == "set" and again["cer_upper_is_meaningful"] and {(r["id"], r["text"]) for r in rows.collect()} == {("1", "数"), ("2", None)}
    with pytest.raises(ValueError):
        benchmark.envelope(df, "set", "test", ["absent"], True)


def test_results_resume(spark, tmp_path):
    path = str(tmp_path / "r")
    planned = spark.createDataFrame([("none",), ("wiener",)], "method string")
    assert records.still_to_do(spark, planned, path).count() == 2
    for n in (1, 2):
        records.write_results(spark.createDataFrame([("none", n)], "method string, v int"), path)
    assert [r["method"] for r in records.still_to_do(spark, planned, path).collect()] == ["wiener"]
    records.write_results(spark.createDataFrame([("wiener", 3)], "method string, v int"), path)
    assert sorted((r["method"], r["v"]) for r in spark.read.parquet(path).collect()) == [("none", 2), ("wiener", 3)]


def test_bad_result_files_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"testset": "t"}))
    (tmp_path / "b.json").write_text("{broken")
    rows = {r["file"]: r for r in records.read_results(spark, str(tmp_path)).collect()}
    assert rows["a.json"]["testset"] == "t" and rows["b.json"]["_corrupt_record"]


def test_real_benchmark(spark):
    src = spark.createDataFrame([(f"s{i}", "n", "t", float(d)) for i, d in enumerate((3, 4, 6, 7, 10, 12))], "source_id string, noisy string, text string, duration_s double")
    assert benchmark.real_benchmark(src, 2).groupBy("duration_bucket").count().count() == 3


def test_fold_equals_a_loop(spark):
    df = spark.createDataFrame([(1, i, bool(i % 3)) for i in range(20)], "id int, idx int, s boolean")
    got = [r["state"] for r in recursive.states(df, F.col("s"), F.lit(1.0), recursive.gate_step()).orderBy("idx").collect()]
    attack, release = recursive.gate_coefficients()
    g, want = 1.0, []
    for i in range(20):
        target = 1.0 if i % 3 else 0.1
        a = attack if target > g else release
        g = a * g + (1 - a) * target
        want.append(g)
    assert np.allclose(got, want)


def test_stream_equals_batch(spark, tmp_path):
    f = Framing(64, 32)
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b"):
        x, seq, at = rng.uniform(-0.5, 0.5, 700), 0, 0
        while at < len(x):
            k = int(rng.integers(1, 90))
            rows.append((s, seq, [float(v) for v in np.float32(x[at : at + k])], json.dumps({"method": "wiener"}) if seq == 0 else None))
            at, seq = at + k, seq + 1
    df = spark.createDataFrame(rows, sessions.CHUNKS)
    for part in range(3):
        df.filter((F.col("seq") * 3 / 20).cast("int") == part if part < 2 else (F.col("seq") * 3 / 20).cast("int") >= 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = sessions.enhance_stream(df, f)
    q = sessions.enhance_stream(sessions.replay(spark, str(tmp_path / "in"), files_per_batch=1), f).writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["session"], r["block"])
    got, want = sorted(spark.table("blocks").collect(), key=key), sorted(batch.collect(), key=key)
    assert len(got) == len(want) == 2 * (700 // 32)
    late = sum(r["late"] for r in got)
    if not late:  # files came in order
        assert max(np.abs(np.array(a["samples"]) - np.array(b["samples"])).max() for a, b in zip(got, want)) < 1e-12


def test_session_drops_late_chunks_and_rebuilds_on_change():
    s = sessions.Session(Framing(64, 32))
    frames = lambda *c: pd.DataFrame(c, columns=["session", "seq", "pcm", "control"])
    assert len(s.take("x", frames(("x", 1, [0.1] * 40, None)))) == 1
    s.take("x", frames(("x", 0, [0.1] * 40, None)))
    assert s.late == 1 and len(s.rest) == 8
    s.take("x", frames(("x", 2, [], '{"method": "none"}')))
    assert len(s.rest) == 8
    s.take("x", frames(("x", 3, [], '{"method": "wiener"}')))
    assert len(s.rest) == 0 and s.pipeline.method == "wiener"


def test_segmenter():
    s = sessions.Segmenter(quiet=3, least=2, longest=10)
    cuts = [s.step(v) for v in [0, 1, 1, 0, 0, 0, 1, 0, 0, 0] + [1] * 11]
    assert [c for c in cuts if c] == [(1, 6), (6, 17)]
    s = sessions.Segmenter()  # a pause after too little speech ends nothing
    cuts = [s.step(v) for v in [1] * 20 + [0] * 30 + [1] * 20 + [0] * 30]
    assert [c for c in cuts if c] == [(0, 100)]


def test_last_baseline_counts(spark):
    rows = spark.createDataFrame([("a", "none", 2.0, 7), ("a", "none", 5.0, 3), ("a", "m", 3.0, 1), ("b", "m", 3.0, 1)], "id string, method string, score double, line int").repartition(3)
    assert [r["delta"] for r in evaluation.against_baseline(rows, ["id"], F.col("line")).filter("method = 'm'").collect()] == [1.0]


def test_places_in_order(spark):
    out = evaluation.numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 AS v"), "place", ["v"]).collect()
    assert all(r["v"] == r["place"] for r in out) and len(out) == 1000


def test_kernels_keep_rows_and_score(spark):
    x = [synth.make_noise("babble", 4000, np.random.default_rng(i)).tolist() for i in range(2)]
    df = spark.createDataFrame([(i, 16_000, v) for i, v in enumerate(x)], "id int, sr int, samples array<double>")
    back = kernels.istft(kernels.stft(df), "id").collect()
    assert all(np.abs(np.array(r["samples"])[:4000] - x[r["id"]]).max() < 1e-9 for r in back)
    assert kernels.map_samples(df, lambda v: 2 * v).first()["samples"][0] == pytest.approx(2 * x[0][0])
    with pytest.raises(KeyError):
        kernels.enhance_signals(df, "magic")


def test_catalogs(spark):
    assert records.metric_catalog(spark).filter("NOT available").count() == 4
    assert records.self_check(spark).filter("NOT ok").count() == 0


def test_session_blocks_has_every_signal(spark):
    from tidesmith.plans import engines

    sf = "/root/testdata/sf0.01"
    sizes = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    out = engines.session_blocks(spark, sf).groupBy("session").agg(F.sum("n").alias("n")).collect()
    assert {r["session"]: r["n"] for r in out} == {str(r["l_suppkey"]): r["count"] // 32 * 32 for r in sizes} and len(out) == 100


def test_lines_that_the_order_leaves_open_stand_as_in_the_files(spark, tmp_path):
    """Of two files the larger is read first, so ties came in its order."""
    from tidesmith.plans import scores

    line = lambda k, d, t: (k, 1, 7, d, t)
    cells = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_discount double, l_tax double"
    rows = [line(1, 0.01, 0.02), line(1, 0.05, 0.01), line(1, 0.1, 0.09), line(1, 0.02, 0.08), line(1, 0.07, 0.01), line(1, 0.03, 0.02)]
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, part in (("a", rows[:3]), ("b", rows[3:] + [line(k, 0.01 * (k % 9), 0.03) for k in range(2, 5000)])):
        spark.createDataFrame(part, cells).coalesce(1).toPandas().to_parquet(folder / f"{name}.parquet")
    r, e = np.array([x[3] for x in rows]), np.array([x[4] for x in rows])
    frames = [(float((r[a : a + 4] ** 2).sum()), float(((r - e)[a : a + 4] ** 2).sum())) for a in (0, 2)]
    want = np.mean([np.clip(10 * np.log10(s / (d + 1e-10)), -10, 35) for s, d in frames])
    assert scores.seg_snr_short(spark, str(tmp_path)).filter("id = 1").first()["seg_snr"] == round(float(want), 4)


def test_kernels_work_on_pieces_of_a_batch():
    p = pd.DataFrame({"id": range(100), "samples": [np.zeros(50)] * 100})
    cut = list(kernels.pieces(iter([p]), "samples", 500))
    assert max(len(q) for q in cut) <= 11 and [i for q in cut for i in q["id"]] == list(range(100)) and list(kernels.pieces(iter([p[:0]]), "samples")) == []
