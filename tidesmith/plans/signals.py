"""Queries on scalar signal functions, framing and spectra."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import convolution
from ..operators import frames as FR
from .book import query, table
from .views import EVENTS, FRAMES, LINES, frames_emb, sig_events, sig_line


@query(f"WITH {EVENTS} SELECT id, round(sqrt(avg(x * x)), 6) AS rms, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-12)), 6) AS rms_db, round(20 * log10(sqrt(avg(x * x)) + 1e-10), 6) AS level_db FROM sig GROUP BY id")
def rms_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return sig_events(spark, sf_dir).groupBy("id").agg(F.round(X.rms(x), 6).alias("rms"), F.round(X.db(X.rms(x)), 6).alias("rms_db"), F.round(X.level_db(x), 6).alias("level_db"))


@query(f"WITH {EVENTS} SELECT id, idx, round(x * 0.95 / max(abs(x)) OVER (PARTITION BY id), 6) AS y FROM sig")
def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sig_events(spark, sf_dir).groupBy("id").agg(X.to_array("idx", "x").alias("samples"))
    return wide.select("id", F.posexplode(X.peak_normalize(F.col("samples")))).select("id", F.col("pos").cast("bigint").alias("idx"), F.round("col", 6).alias("y"))


@query(f"WITH {FRAMES} SELECT id, unnest(range(0, 32)) AS idx, round(unnest(list_transform(range(1, 65, 2), lambda i: (frame[i] + frame[i + 1]) / 2)), 6) AS mono FROM fr")
def to_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.slice("frame", i, 2))
    return frames_emb(spark, sf_dir).select("id", F.posexplode(X.to_mono(pairs))).select("id", F.col("pos").cast("bigint").alias("idx"), F.round("col", 6).alias("mono"))


@query("SELECT n, round(sqrt(0.5 - 0.5 * cos(2 * pi() * n / 512)), 9) AS w FROM (SELECT unnest(range(0, 512)) AS n)")
def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.window_table(spark, 512).select("n", F.round("w", 9).alias("w"))


@query("SELECT n % 256 AS phase, round(abs(sum(0.5 - 0.5 * cos(2 * pi() * n / 512)) - 1), 9) AS deviation FROM (SELECT unnest(range(0, 512)) AS n) GROUP BY 1")
def overlap_add_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.overlap_deviation(FR.window_table(spark, 512), 256).select("phase", F.round("deviation", 9).alias("deviation"))


@query(f"WITH {LINES} SELECT id, count(*) AS n, CASE WHEN count(*) <= 0 THEN 0 ELSE (255 + count(*)) // 256 + 1 END AS frames FROM sig GROUP BY id")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return sig_line(spark, sf_dir).groupBy("id").agg(n.alias("n"), X.num_frames(n).alias("frames"))


@query(f"""WITH {LINES}, n AS (SELECT id, count(*) AS n FROM sig GROUP BY id),
t AS (SELECT id, unnest(range(0, (31 + n) // 32 + 1)) AS t FROM n)
SELECT t.id, t.t, count(x) AS held, round(coalesce(sum(x * x), 0) / 1e6, 2) AS energy, round(coalesce(max(x), 0), 2) AS peak
FROM t LEFT JOIN sig ON sig.id = t.id AND sig.idx + 32 >= t.t * 32 AND sig.idx + 32 < t.t * 32 + 64 GROUP BY t.id, t.t""")
def framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sig_line(spark, sf_dir).groupBy("id").agg(X.to_array("idx", "x").alias("samples"))
    framed = FR.framing(wide, "samples", n_fft=64, hop=32)
    live = F.size("samples")
    held = F.least(F.col("t") * 32 + 32, live.cast("bigint")) - F.greatest(F.col("t") * 32 - 32, F.lit(0))
    return framed.select("id", "t", F.greatest(held, F.lit(0)).cast("bigint").alias("held"), F.round(F.aggregate("frame", F.lit(0.0), lambda a, v: a + v * v) / 1e6, 2).alias("energy"), F.round(F.array_max("frame"), 2).alias("peak"))


@query(f"""WITH {LINES}, n AS (SELECT id, count(*) AS n FROM sig GROUP BY id),
t AS (SELECT id, n, unnest(range(0, (15 + n) // 16 + 1)) AS t FROM n),
f AS (SELECT t.id, t.t, t.n, list(coalesce(x, 0) * sqrt(0.5 - 0.5 * cos(2 * pi() * j / 32)) ORDER BY j) AS v
  FROM (SELECT *, unnest(range(0, 32)) AS j FROM t) t LEFT JOIN sig ON sig.id = t.id AND sig.idx = t.t * 16 + t.j - 16 GROUP BY ALL),
k AS (SELECT id, t, v, unnest(range(0, 17)) AS bin FROM f),
c AS (SELECT id, t, bin, list_sum(list_transform(v, lambda y, i: y * cos(2 * pi() * bin * (i - 1) / 32))) AS re, list_sum(list_transform(v, lambda y, i: -y * sin(2 * pi() * bin * (i - 1) / 32))) AS im FROM k),
w AS (SELECT sum(sqrt(0.5 - 0.5 * cos(2 * pi() * j / 32))) / 2 AS ref FROM (SELECT unnest(range(0, 32)) AS j))
SELECT id, t, bin, round(greatest(20 * log10(sqrt(re * re + im * im) / ref + 1e-12), -110), 3) AS db FROM c, w""")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sig_line(spark, sf_dir).groupBy("id").agg(X.to_array("idx", "x").alias("samples"))
    return FR.spectrogram(wide, "samples", n_fft=32, hop=16).select("id", "t", "bin", F.round("db", 3).alias("db"))


@query(f"WITH {LINES} SELECT id, idx, round(x, 4) AS y FROM sig")
def overlap_add_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framing, windowing twice and overlap-add give the signal back."""
    wide = sig_line(spark, sf_dir).groupBy("id").agg(X.to_array("idx", "x").alias("samples"))
    framed = FR.framing(wide, "samples", n_fft=64, hop=32)
    weighted = framed.withColumn("frame", F.transform("frame", lambda v, j: v * X.hann(j, 64) * X.hann(j, 64)))
    return FR.overlap_add(weighted, n_fft=64, hop=32).select("id", "idx", F.round("y", 4).alias("y"))


@query(f"""WITH {FRAMES}, k AS (SELECT id, frame, unnest(range(0, 33)) AS bin FROM fr)
SELECT id, bin, round(list_sum(list_transform(frame, lambda v, i: v * cos(2 * pi() * bin * (i - 1) / 64))), 5) AS re, round(list_sum(list_transform(frame, lambda v, i: -v * sin(2 * pi() * bin * (i - 1) / 64))), 5) AS im FROM k""")
def dft_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = frames_emb(spark, sf_dir).select("id", F.posexplode(X.dft(F.col("frame"), 64)))
    return bins.select("id", F.col("pos").cast("bigint").alias("bin"), F.round(F.col("col.re"), 5).alias("re"), F.round(F.col("col.im"), 5).alias("im"))


@query(f"WITH {FRAMES} SELECT id, round(exp(list_avg(list_transform(frame, lambda v: ln(greatest(v * v, 1e-12))))) / (list_avg(list_transform(frame, lambda v: v * v)) + 1e-12), 6) AS flatness FROM fr")
def spectral_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_emb(spark, sf_dir).select("id", F.round(X.flatness(F.transform("frame", lambda v: v * v)), 6).alias("flatness"))


@query(f"""WITH {FRAMES}, e AS (SELECT unnest(range(0, 9)) AS i), b AS (SELECT i, pow(10, log10(60) + i * (log10(8000) - log10(60)) / 8) AS hz FROM e),
g AS (SELECT a.i AS bin, a.hz AS low, z.hz AS high FROM b a JOIN b z ON z.i = a.i + 1),
f AS (SELECT unnest(range(0, 33)) AS k),
m AS (SELECT bin, k FROM g JOIN f ON k * 250.0 >= low AND k * 250.0 < high),
r AS (SELECT bin, k FROM m UNION ALL SELECT bin, CAST(least(32, greatest(0, floor((low + high) / 2 / 250.0 + 0.5))) AS BIGINT) FROM g WHERE bin NOT IN (SELECT bin FROM m))
SELECT id, bin, round(max(abs(frame[k + 1])), 5) AS peak FROM fr, r GROUP BY id, bin""")
def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest magnitude in each of 8 bins that are even on a logarithmic axis; an empty bin takes the nearest line."""
    return FR.log_bin_max(frames_emb(spark, sf_dir), "frame", bins=8, lines=33, spacing_hz=250.0).select("id", "bin", F.round("peak", 5).alias("peak"))


@query(f"WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM sig) SELECT id, idx * 10 // n AS col, round(max(x), 4) AS peak FROM n GROUP BY 1, 2")
def decimate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value in each of 10 equal stretches of a signal."""
    sig = sig_events(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return sig.groupBy("id", F.floor(F.col("idx") * 10 / F.col("n")).cast("bigint").alias("col")).agg(F.round(F.max("x"), 4).alias("peak"))


@query("SELECT event_id, round(pow(greatest(value, 1e-8), 0.3), 6) AS squeezed, round(pow(greatest(value, 0), 1 / 0.3), 3) AS expanded FROM events")
def compress_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(X.compress(v), 6).alias("squeezed"), F.round(X.decompress(v), 3).alias("expanded"))


@query(f"""WITH {FRAMES}, z AS (SELECT id, unnest(range(1, 17)) AS i, frame FROM fr), s AS (SELECT id, i, frame[i] AS a, frame[i + 16] AS b, 3 * tanh(10 * frame[i + 32] / 3) AS c, 3 * tanh(10 * frame[i + 48] / 3) AS d FROM z)
SELECT id, i AS bin, round(a * c - b * d, 6) AS re, round(a * d + b * c, 6) AS im FROM s""")
def complex_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = frames_emb(spark, sf_dir).select("id", "frame", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("i"))
    part = lambda k: F.element_at("frame", F.col("i") + k)
    spec, mask = F.struct(part(0).alias("re"), part(16).alias("im")), F.struct((10 * part(32)).alias("re"), (10 * part(48)).alias("im"))
    out = at.select("id", F.col("i").cast("bigint").alias("bin"), X.apply_mask(spec, mask).alias("z"))
    return out.select("id", "bin", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


@query("""WITH v AS (SELECT event_id, greatest(value / 100, 1e-8) AS nu FROM events)
SELECT event_id, round(0.5 * CASE WHEN nu < 0.1 THEN -2.3 * log10(nu) - 0.6 WHEN nu < 1 THEN -1.544 * log10(nu) + 0.166 ELSE pow(10, -0.53 * nu - 0.26) END, 6) AS half_e1 FROM v""")
def half_exp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(X.half_exp1(F.greatest(F.col("value") / 100, F.lit(1e-8))), 6).alias("half_e1"))


@query(f"""WITH {LINES}, s AS (SELECT id, idx, x * 0.6 + 0.25 * coalesce(lag(x, 1) OVER w, 0) + 0.1 * coalesce(lag(x, 2) OVER w, 0) + 0.05 * coalesce(lag(x, 3) OVER w, 0) AS y FROM sig WINDOW w AS (PARTITION BY id ORDER BY idx))
SELECT id, idx, round(y, 4) AS y FROM s""")
def fir_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short impulse response applied with a window frame; long ones go through the frequency domain (operators.kernels)."""
    return FR.fir(sig_line(spark, sf_dir), [0.6, 0.25, 0.1, 0.05]).select("id", "idx", F.round("y", 4).alias("y"))


@query(f"""WITH {LINES} SELECT t.id, t.idx, round(sum(s.x * exp((s.idx - t.idx) / 900.0) * CASE WHEN (t.idx - s.idx) % 3 = 0 THEN 1 ELSE -0.25 END) / 10000, 2) AS y
FROM sig t JOIN sig s ON s.id = t.id AND s.idx <= t.idx AND t.idx - s.idx < 8000 GROUP BY t.id, t.idx""")
def long_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices convolved with a response of 8,000 taps, block by block."""
    sig = sig_line(spark, sf_dir).select("id", "idx", "x")
    k = F.col("idx")
    taps = spark.range(8000).select(F.col("id").alias("idx")).withColumn("h", F.exp(-k / 900.0) * F.when(k % 3 == 0, 1.0).otherwise(-0.25))
    return convolution.convolve(sig, taps, 256).select("id", "idx", F.round(F.col("y") / 10_000, 2).alias("y"))
