import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.kernels import synth
from tidesmith.operators import jobs


@pytest.fixture(scope="module")
def test_set(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3):
        clean = 0.3 * synth.make_noise("babble", 16_000, np.random.default_rng(i))
        rows.append((f"r{i}", "0", clean.tolist(), (clean + 0.05 * rng.normal(size=16_000)).tolist()))
    return spark.createDataFrame(rows, "id string, snr string, clean array<double>, noisy array<double>")


def test_evaluation_resumes_and_summarizes(spark, test_set, tmp_path):
    path = str(tmp_path / "results")
    assert jobs.evaluate_job(test_set, ["none"], ["snr"], path, False).count() == 3
    out = jobs.evaluate_job(test_set, ["none", "wiener"], ["snr"], path, False)
    assert out.groupBy("method").count().count() == 2
    rows = {r["method"]: r for r in jobs.summarize_job(out, resamples=100).collect()}
    assert rows["none"]["delta"] is None and rows["wiener"]["n"] == 3 and rows["wiener"]["delta_low"] <= rows["wiener"]["delta"] <= rows["wiener"]["delta_high"]
    with pytest.raises(KeyError):
        jobs.evaluate_job(test_set, ["magic"], ["snr"], path)
    with pytest.raises(ValueError):
        jobs.evaluate_job(test_set, ["none"], ["absent"], path)


def test_enhancing_reports_differences(test_set):
    sig = test_set.select("id", F.col("noisy").alias("samples"), "clean")
    row = jobs.enhance_job(sig, "none", "clean").first()
    assert abs(row["si_sdr"]["delta"]) < 1e-6 and len(row["frames"]) == 63 + 1


def test_lab_and_demo(test_set):
    sig = test_set.limit(1).select("id", F.col("clean").alias("samples"))
    rows = jobs.lab_job(sig, ("none", "wiener"), "white", 5.0, 0.2).collect()
    assert len(rows) == 2 and all(len(r["spectrogram"][0]) == 96 and r["wav"].startswith("UklGR") and r["rtf"] < 1 for r in rows)
    assert np.abs(jobs.demo_mix(sig, "white", -20).first()["samples"]).max() <= 1


def test_error_rates(spark):
    df = spark.createDataFrame([("1", "clean", "十二个", "12个"), ("2", "clean", "a b", "a c"), ("1", "noisy", "甲乙", "甲")], "id string, source string, reference string, hypothesis string")
    out = {r["source"]: r for r in jobs.error_rate_job(df).collect()}
    assert out["noisy"]["cer"] == 0.5 and out["clean"]["cer"] == 0.25 and out["clean"]["wer"] == 0.25
