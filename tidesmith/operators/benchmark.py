"""Construction of test sets: strata, validity of sources, index records and their envelope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the test sets.
SNRS = (-5, 0, 5, 10, 15)
NOISE_KINDS = ("stationary", "nonstationary")
RIR_KINDS = ("synth", "real")
RT60_BUCKETS = (0.2, 0.4, 0.6, 0.8)
SCHEMA_VERSION = 2

CONTROLLED = (
    "id string, source_id string, noisy string, clean string, duration_s double, snr_label string, snr_db int, snr_measured double, storage_gain double, "
    "noise_kind string, rir_kind string, rt60_bucket double, rt60_nominal double, rt60_measured double, text string"
)
REAL = "id string, source_id string, noisy string, text string, duration_s double, duration_bucket string"


def strata(spark: SparkSession, snrs: Sequence[int] = SNRS) -> DataFrame:
    """(cell, snr_label, snr_db, noise_kind, rir_kind, rt60_bucket): all combinations in order, and the identity cell last."""
    cells = [(str(s), s, n, r, t) for s in snrs for n in NOISE_KINDS for r in RIR_KINDS for t in RT60_BUCKETS]
    rows = [(i, *c) for i, c in enumerate([*cells, ("clean", None, "none", "none", 0.0)])]
    return spark.createDataFrame(rows, "cell int, snr_label string, snr_db int, noise_kind string, rir_kind string, rt60_bucket double")


def record_id(cell: Column, noise: Column, snr: Column, rir: Column, rt60: Column) -> Column:
    return F.format_string("%05d_%s_snr%s_%s_rt%.1f", cell, noise, snr, rir, rt60)


def _finite(samples: Column) -> Column:
    return F.forall(samples, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def valid_source(samples: Column, least: int = 16_000) -> Column:
    """Long enough, finite, not silent."""
    return (F.size(samples) >= least) & _finite(samples) & (F.array_max(F.transform(samples, F.abs)) > 1e-9)


def valid_noise(samples: Column, least: int = 8_000) -> Column:
    """Long enough, finite, with energy besides its mean."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
    power = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v * v) / F.greatest(n, F.lit(1))
    return (n >= least) & _finite(samples) & (power - mean * mean > 1e-12)


def usable_noise(noises: DataFrame, sr: int = 16_000, seconds: float = 10.0, least_frames: int = 32, n_fft: int = 512, hop: int = 256) -> DataFrame:
    """noises (id, samples, ..) that can be told stationary or not: the first `seconds` without their mean, finite, with energy, and of `least_frames` frames; n_frames says how many."""
    from ..functions.expressions import num_frames

    cut = noises.withColumn("samples", F.slice("samples", 1, int(seconds * sr))).filter(F.size("samples") > 0)
    cut = cut.filter(valid_noise(F.col("samples"), 1))
    mean = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size("samples"), F.lit(1))
    # the mean is repeated, since a lambda would work it out again for each sample
    centred = F.zip_with("samples", F.array_repeat(mean, F.size("samples")), lambda v, m: v - m)
    return cut.withColumn("samples", centred).withColumn("n_frames", num_frames(F.size("samples"), n_fft, hop)).filter(F.col("n_frames") >= least_frames)


def envelope(records: DataFrame, dataset_id: str, purpose: str, strata_names: Sequence[str], reference_is_clean: bool, cer_per_cell: int | None = None) -> dict:
    """What an index says of itself besides its records; strata must be columns of the records."""
    from .evaluation import check_strata

    check_strata(records, strata_names)
    return {
        "schema_version": SCHEMA_VERSION, "dataset_id": dataset_id, "purpose": purpose, "reference_is_clean": reference_is_clean,
        "cer_upper_is_meaningful": reference_is_clean and "text" in records.columns, "strata": list(strata_names), "cer_per_cell_default": cer_per_cell,
    }


def real_benchmark(sources: DataFrame, per_bucket: int, edges: Sequence[float] = (0.0, 5.0, 9.0, float("inf")), names: Sequence[str] = ("short", "medium", "long")) -> DataFrame:
    """Index records of recordings as they are: the first per_bucket of each duration bucket, in id order; too few raise."""
    from .evaluation import bucket, filled_buckets

    known = sources.withColumn("duration_bucket", bucket(F.col("duration_s"), edges, names)).filter("duration_bucket IS NOT NULL AND text IS NOT NULL AND text <> ''")
    picked = filled_buckets(known, "duration_bucket", ["source_id"], per_bucket)
    number = F.format_string("%05d_%s", F.col("place") - 1, "duration_bucket")
    return picked.select(number.alias("id"), "source_id", "noisy", "text", F.round("duration_s", 3).alias("duration_s"), "duration_bucket")
