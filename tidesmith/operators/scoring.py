"""Scores of an estimate against a reference, and statistics of signals, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import quantiles

EPS = 1e-10


def si_sdr(pairs: DataFrame) -> DataFrame:
    """(id, si_sdr) of rows (id, ref, est): scale-invariant ratio after removing means. Two passes for accuracy; both share the partitioning on id."""
    w = Window.partitionBy("id")
    r, e = F.col("ref") - F.avg("ref").over(w), F.col("est") - F.avg("est").over(w)
    m = pairs.select("id", r.alias("r"), e.alias("e"))
    m = m.withColumn("s", F.sum(F.col("e") * F.col("r")).over(w) / (F.sum(F.col("r") * F.col("r")).over(w) + EPS))
    target, rest = F.col("s") * F.col("r"), F.col("e") - F.col("s") * F.col("r")
    return m.groupBy("id").agg((10 * F.log10((F.sum(target * target) + EPS) / (F.sum(rest * rest) + EPS))).alias("si_sdr"))


def sdr(pairs: DataFrame) -> DataFrame:
    d = F.col("est") - F.col("ref")
    return pairs.groupBy("id").agg((10 * F.log10((F.sum(F.col("ref") * F.col("ref")) + EPS) / (F.sum(d * d) + EPS))).alias("sdr"))


def frames_of(rows: DataFrame, frame: int, hop: int, short: bool = False) -> DataFrame:
    """Repeats each row (id, idx, ..) for every full frame it lies in, as column t; needs the signal's length n. `short`: a signal shorter than a frame is one frame."""
    last = F.greatest(F.floor((F.col("n") - frame) / hop), F.lit(0))
    first = F.greatest(F.ceil((F.col("idx") - frame + 1) / hop), F.lit(0))
    until = F.least(F.floor(F.col("idx") / hop), last)
    return (rows if short else rows.filter(F.col("n") >= frame)).withColumn("t", F.explode(F.when(first <= until, F.sequence(first.cast("bigint"), until.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))


def seg_snr(pairs: DataFrame, frame: int = 512, hop: int = 256, low: float = -10.0, high: float = 35.0) -> DataFrame:
    """(id, seg_snr): mean over non-silent frames of the clipped frame SNR; null without such frames.

    A frame is silent if its summed energy is below 1e-4 of the signal's mean
    energy: sum against mean, as the published results have it. So no frame of a
    silent reference is, and each counts as `low`. A signal shorter than a frame
    is one frame.
    """
    r, d = F.col("ref"), F.col("ref") - F.col("est")
    own = pairs.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), (F.avg(r * r) * 1e-4).alias("gate"))
    each = pairs.join(own, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    framed = frames_of(each, frame, hop, short=True).groupBy("id", "t").agg(F.sum(r * r).alias("s"), F.sum(d * d).alias("e"), F.first("gate").alias("gate"))
    ratio = F.when(F.col("s") > 0, 10 * F.log10(F.col("s") / (F.col("e") + EPS))).otherwise(F.lit(low))
    snr = F.least(F.greatest(ratio, F.lit(low)), F.lit(high))
    return framed.groupBy("id").agg(F.avg(F.when(F.col("s") >= F.col("gate"), snr)).alias("seg_snr"))


def active_frames(sig: DataFrame, frame: int = 512, hop: int = 256, rel_db: float = -35.0) -> DataFrame:
    """(id, t): full frames whose energy is within rel_db of the loudest frame's."""
    n = sig.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    e = frames_of(n, frame, hop).groupBy("id", "t").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    return e.withColumn("most", F.max("e").over(Window.partitionBy("id"))).filter(F.col("e") >= F.col("most") * 10 ** (rel_db / 10)).select("id", "t")


def measured_snr(pairs: DataFrame) -> DataFrame:
    """(id, snr): ratio of the AC powers of reference and error."""
    return pairs.groupBy("id").agg((10 * X.log10(F.var_pop("ref") / F.greatest(F.var_pop(F.col("est") - F.col("ref")), F.lit(1e-20)))).alias("snr"))


def energy_decay(sig: DataFrame) -> DataFrame:
    """(id, idx, edc_db): backward-integrated energy from the first of the largest samples on, 0 dB there."""
    w = Window.partitionBy("id")
    peak = sig.withColumn("top", F.max(F.abs("x")).over(w))
    start = peak.withColumn("start", F.min(F.when(F.abs("x") == F.col("top"), F.col("idx"))).over(w)).filter("idx >= start")
    back = start.withColumn("rest", F.sum(F.col("x") * F.col("x")).over(w.orderBy(F.desc("idx"))))
    total = F.max("rest").over(w)
    return back.select("id", (F.col("idx") - F.col("start")).alias("idx"), F.when(total > 0, 10 * F.log10(F.greatest(F.col("rest") / total, F.lit(1e-20)))).alias("edc_db"))


def decay_time(edc: DataFrame, sr: float, low_db: float = -5.0, high_db: float = -35.0) -> DataFrame:
    """(id, t60): from the slope of the decay between the first samples at or under low_db and high_db; null where it cannot be told."""
    bounds = edc.withColumn("a", F.min(F.when(F.col("edc_db") <= low_db, F.col("idx"))).over(Window.partitionBy("id"))).withColumn("b", F.min(F.when(F.col("edc_db") <= high_db, F.col("idx"))).over(Window.partitionBy("id")))
    inside = (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))
    y, t = F.when(inside, F.col("edc_db")), F.when(inside, F.col("idx") / sr)
    fit = bounds.groupBy("id").agg(F.regr_slope(y, t).alias("slope"), F.count(y).alias("points"))
    return fit.select("id", F.when((F.col("points") >= 2) & (F.col("slope") < -1e-9), -60 / F.col("slope")).alias("t60"))


def latency(frames: DataFrame, ms: Column, by: str, budget_ms: float, frame_s: float, limit: int = quantiles.LIMIT) -> DataFrame:
    """Count, sum, percentiles, largest, real-time factor and whether the 99th percentile is within the budget. Percentiles are exact for groups of any size: no task sorts more than `limit` values."""
    p = quantiles.grouped(frames, by, ms, (0.5, 0.95, 0.99), limit).withColumnRenamed(by, "_by")
    agg = frames.groupBy(by).agg(F.count(F.lit(1)).alias("n_frames"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"))
    agg = agg.join(p, F.col(by).eqNullSafe(F.col("_by")), "left")
    rtf = F.col("total_ms") / 1000 / (F.col("n_frames") * frame_s)
    return agg.select(by, "n_frames", "total_ms", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "max_ms", rtf.alias("rtf"), (F.col("q")[2] < budget_ms).alias("realtime_ok"))


def stationarity(sig: DataFrame, half: int = 31, least_frames: int = 31, most_db: float = 9.0) -> DataFrame:
    """(id, n, range_db, stationary) of frame powers: spread of the level around its moving median after smoothing over five frames."""
    w = Window.partitionBy("id").orderBy("idx")
    smooth = sig.withColumn("p", F.sum("x").over(w.rowsBetween(-2, 2)) / 5).withColumn("e", 10 * F.log10(F.greatest(F.col("p"), F.lit(0.0)) + 1e-12))
    rest = smooth.withColumn("r", F.col("e") - F.percentile("e", 0.5).over(w.rowsBetween(-half, half)))
    out = rest.groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.percentile("r", 0.95) - F.percentile("r", 0.05)).alias("range_db"))
    return out.withColumn("stationary", (F.col("n") >= least_frames) & (F.col("range_db") < most_db))
