"""Framing, windows, spectra and overlap-add as DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X


def window_table(spark: SparkSession, size: int) -> DataFrame:
    """(n, w): the root of a periodic Hann window."""
    return spark.range(size).select(F.col("id").alias("n"), X.hann(F.col("id"), size).alias("w"))


def overlap_deviation(window: DataFrame, hop: int) -> DataFrame:
    """(phase, deviation): how far the squared window's overlapped sum is from one."""
    return window.groupBy((F.col("n") % hop).alias("phase")).agg(F.abs(F.sum(F.col("w") * F.col("w")) - 1).alias("deviation"))


def framing(df: DataFrame, samples: str, n_fft: int = 512, hop: int = 256) -> DataFrame:
    """A row (.., t, frame) for each frame: n_fft - hop zeros lead, zeros fill the last frame, so every sample is covered. No shuffle."""
    pad = n_fft - hop
    n = F.size(samples)
    count = X.num_frames(n, n_fft, hop)
    padded = F.concat(F.array_repeat(F.lit(0.0), pad), F.col(samples), F.array_repeat(F.lit(0.0), (n_fft + hop)))
    t = F.sequence(F.lit(0).cast("bigint"), count - 1)
    cut = X.once(padded, lambda p: F.transform(t, lambda k: F.struct(k.alias("t"), F.slice(p, (k * hop + 1).cast("int"), n_fft).alias("frame"))))
    return df.filter(n > 0).select("*", F.inline(cut))


def spectrogram(df: DataFrame, samples: str, n_fft: int = 512, hop: int = 256, floor_db: float = -110.0) -> DataFrame:
    """(.., t, bin, db): a full-scale sine is at 0 dB. The transform is a product with a table of cosines and sines for many frames at once."""
    ref = sum(math.sqrt(0.5 - 0.5 * math.cos(2 * math.pi * j / n_fft)) for j in range(n_fft)) / 2
    kept = [c for c in df.columns if c != samples]
    framed = framing(df.select(*kept, samples), samples, n_fft, hop).drop(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(n_fft)
        angle = 2 * np.pi * np.outer(at, np.arange(n_fft // 2 + 1)) / n_fft
        table = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * at / n_fft))[:, None] * np.exp(-1j * angle)
        for b in batches:
            spec = b.column("frame").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_fft)
            spec = np.hypot(spec @ table.real, spec @ table.imag)
            db = np.maximum(20 * np.log10(spec / ref + 1e-12), floor_db).reshape(-1)
            levels = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (n_fft // 2 + 1)), pa.array(db))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*kept, "t")), levels], names=[*kept, "t", "levels"])

    kind = T.StructType([*(framed.schema[c] for c in (*kept, "t")), T.StructField("levels", T.ArrayType(T.DoubleType()))])
    bins = framed.mapInArrow(run, kind).select(*kept, "t", F.posexplode("levels").alias("bin", "db"))
    return bins.withColumn("bin", F.col("bin").cast("bigint"))


def overlap_add(framed: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(id, idx, y) from rows (id, samples, t, frame): frames are added where they overlap, the leading zeros and the tail are cut."""
    each = framed.select("id", F.size("samples").alias("n"), "t", F.posexplode("frame"))
    at = F.col("t") * hop + F.col("pos") - (n_fft - hop)
    return each.select("id", "n", at.alias("idx"), "col").filter("idx >= 0 AND idx < n").groupBy("id", "idx").agg(F.sum("col").alias("y"))


def log_bin_max(df: DataFrame, frame: str, bins: int, lines: int, spacing_hz: float, low_hz: float = 60.0, high_hz: float = 8000.0) -> DataFrame:
    """(id, bin, peak): the largest magnitude of the lines in each logarithmic bin; a bin without a line takes the nearest. The map of bins is a literal."""
    edges = [10 ** (math.log10(low_hz) + i * (math.log10(high_hz) - math.log10(low_hz)) / bins) for i in range(bins + 1)]
    groups = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        held = [k for k in range(lines) if a <= k * spacing_hz < z]
        groups.append(held or [min(lines - 1, max(0, math.floor((a + z) / 2 / spacing_hz + 0.5)))])
    peaks = F.array(*(F.array_max(F.array(*(F.abs(F.element_at(frame, k + 1)) for k in g))) for g in groups))
    return df.select("id", F.posexplode(peaks)).select("id", F.col("pos").cast("bigint").alias("bin"), F.col("col").alias("peak"))


def fir(sig: DataFrame, taps: Sequence[float]) -> DataFrame:
    """(id, idx, y): convolution with a few taps over a window frame."""
    w = Window.partitionBy("id").orderBy("idx")
    y = F.lit(0.0)
    for k, tap in enumerate(taps):
        y = y + tap * (F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) if k else F.col("x"))
    return sig.select("id", "idx", y.alias("y"))
