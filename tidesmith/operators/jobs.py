"""Whole jobs, composed of operators: enhancing recordings, evaluating methods with resume, the lab's comparison, the demo mixture."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..kernels import enhance, metrics, spectral, synth
from ..sources import records
from ..sources.audio import wav_base64
from . import kernels as K
from .evaluation import check_strata, finite
from .resampling import bootstrap

LONGEST_S = 20.0


def enhance_job(signals: DataFrame, method: str, reference: str | None = None, gated: bool = False) -> DataFrame:
    """Enhanced signals with frame records; with a reference column also the scores before and after and their differences."""
    out = K.enhance_signals(signals, method, gated=gated)
    if reference is None:
        return out
    both = signals.select("id", F.col(reference).alias("ref"), "samples").join(out.select("id", F.col("samples").alias("after")), "id")
    before = K.score(both.select("id", "ref", F.col("samples").alias("est")))
    after = K.score(both.select("id", "ref", F.col("after").alias("est")))
    names = [c for c in before.columns if c != "id"]
    delta = before.alias("b").join(after.alias("a"), "id").select("id", *(F.struct(F.col(f"b.{n}").alias("before"), F.col(f"a.{n}").alias("after"), (F.col(f"a.{n}") - F.col(f"b.{n}")).alias("delta")).alias(n) for n in names))
    return out.join(delta, "id")


def evaluate_job(test_set: DataFrame, methods: Sequence[str], strata: Sequence[str], path: str, intelligibility: bool = True) -> DataFrame:
    """Scores of all methods over a test set (id, noisy, clean, strata..), written by method; methods with results are not run again. Returns all results."""
    spark = test_set.sparkSession
    check_strata(test_set, strata)
    for m in methods:
        enhance.build(m)  # unknown methods are an error before any work
    planned = spark.createDataFrame([(m,) for m in methods], "method string")
    for m in [r["method"] for r in records.still_to_do(spark, planned, path).orderBy("method").collect()]:
        pairs = test_set.select("id", *strata, F.col("clean").alias("ref"), F.col("noisy").alias("samples"))
        est = K.enhance_signals(pairs, m).select("id", *strata, "ref", F.col("samples").alias("est"))
        records.write_results(K.score(est, intelligibility=intelligibility).withColumn("method", F.lit(m)), path)
    return spark.read.parquet(path).withColumn("method", F.col("method").cast("string"))


def summarize_job(results: DataFrame, metric: str = "si_sdr", baseline: str = "none", resamples: int = 2000) -> DataFrame:
    """(method, n, mean, low, high, delta, delta_low, delta_high): means and paired differences with 95 % intervals."""
    rows = results.select("id", "method", finite(F.col(metric)).alias("v")).filter("v IS NOT NULL")
    base = rows.filter(F.col("method") == baseline).select("id", F.col("v").alias("base"))
    deltas = rows.filter(F.col("method") != baseline).join(base, "id").withColumn("d", F.col("v") - F.col("base"))
    means = bootstrap(rows, "method", "v", "id", resamples)
    paired = bootstrap(deltas, "method", "d", "id", resamples).select("method", F.col("mean").alias("delta"), F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
    return means.join(paired, "method", "left")


def error_rate_job(transcripts: DataFrame) -> DataFrame:
    """(source, n, cer, wer) of rows (id, source, reference, hypothesis): means of the utterances' rates after normalisation."""
    r, h = F.col("reference"), F.col("hypothesis")
    plain = transcripts.withColumns({"_rc": T.for_cer(r), "_hc": T.for_cer(h), "_rw": T.for_wer(r), "_hw": T.for_wer(h)})
    rated = plain.withColumns({"cer": T.cer(F.col("_rc"), F.col("_hc")), "wer": T.wer(F.col("_rw"), F.col("_hw"))})
    return rated.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"))


def _mixture(x: np.ndarray, kind: str, snr_db: float, t60: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(noisy, reverberant clean) of at most 20 s at a peak of 0.7: room first, then noise."""
    x = np.asarray(x, float)[: int(LONGEST_S * spectral.SAMPLE_RATE)]
    x = x * 0.7 / max(np.abs(x).max(initial=0), 1e-12)
    clean = spectral.convolve(x, synth.room_response(t60)) if t60 > 0 else x
    noisy, _ = synth.mix_at_snr(clean, synth.make_noise(kind, len(clean), np.random.default_rng(seed)), snr_db)
    return noisy, clean


def demo_mix(signals: DataFrame, kind: str = "babble", snr_db: float = 5.0, t60: float = 0.0) -> DataFrame:
    """signals with noise and room added, within [-1, 1]."""
    return K.map_samples(signals, lambda x: np.clip(_mixture(x, kind, snr_db, t60)[0], -1, 1))


def spectrogram_columns(x: np.ndarray, bins: int = 96, columns: int = 400) -> list[list[float]]:
    """Levels in dB by logarithmic bins and stretches of time, the largest of each, rounded to a tenth."""
    level = spectral.magnitude_db(spectral.stft(x))
    edges = np.geomspace(60, 8000, bins + 1)
    hz = np.arange(level.shape[1]) * spectral.SAMPLE_RATE / spectral.N_FFT
    lines = [np.flatnonzero((hz >= a) & (hz < b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    lines = [k if len(k) else np.array([np.abs(hz - (a + b) / 2).argmin()]) for k, a, b in zip(lines, edges[:-1], edges[1:], strict=True)]
    grouped = np.stack([level[:, k].max(axis=1) for k in lines], axis=1)
    cuts = np.linspace(0, len(grouped), min(columns, len(grouped)) + 1).astype(int)
    return [np.round(grouped[a:b].max(axis=0), 1).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def lab_job(signals: DataFrame, methods: Sequence[str] = ("none", "specsub", "wiener", "mmse-lsa"), kind: str = "babble", snr_db: float = 5.0, t60: float = 0.0) -> DataFrame:
    """(id, method, scores against the reverberant clean signal, latency, share of speech, WAV in base64, spectrogram)."""
    spark: SparkSession = signals.sparkSession
    grid = signals.select("id", "samples").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in methods], "method string")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, x, m in zip(p["id"], p["samples"], p["method"], strict=True):
                noisy, clean = _mixture(x, kind, snr_db, t60)
                y, frames = enhance.Pipeline(m).signal(noisy)
                ms = [f["proc_ms"] for f in frames]
                took = enhance.percentiles(ms)
                rows.append([i, m, metrics.si_sdr(clean, y), metrics.stoi(clean, y), metrics.stoi(clean, y, extended=True), took.get("p50"), took.get("p99"), sum(ms) / 1000 / max(len(y) / spectral.SAMPLE_RATE, 1e-9), float(np.mean([f["is_speech"] for f in frames])) if frames else None, wav_base64(y), spectrogram_columns(y)])
            yield pd.DataFrame(rows, columns=names)

    names = ["id", "method", "si_sdr", "stoi", "estoi", "p50_ms", "p99_ms", "rtf", "speech_ratio", "wav", "spectrogram"]
    kind_of = signals.schema["id"].dataType.simpleString()
    return grid.mapInPandas(run, f"id {kind_of}, method string, " + ", ".join(f"{n} double" for n in names[2:9]) + ", wav string, spectrogram array<array<double>>")
