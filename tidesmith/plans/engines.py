"""Queries that run kernels, catalogs and state machines over the driver's tables. What SQL can say has an oracle; the others are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..kernels.enhance import METHODS
from ..kernels.spectral import Framing
from ..operators import benchmark as B
from ..operators import kernels as K
from ..operators import scans
from ..sources import records
from ..streaming import sessions
from .book import query, table
from .views import EVENTS, sig_events, sig_line

SHORT = Framing(64, 32)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sr, samples): prices as signals within [-1, 1]."""
    wide = sig_line(spark, sf_dir).groupBy("id").agg(X.to_array("idx", "x").alias("samples"))
    return wide.select("id", F.lit(16_000).alias("sr"), X.peak_normalize(F.col("samples"), 0.7).alias("samples"))


@query()
def enhance_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method over every signal: level before and after, frames with speech."""
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    done = K.enhance_signals(signals(spark, sf_dir), list(METHODS), framing=SHORT)
    return done.select("id", "method", F.round(energy("samples"), 4).alias("energy"), F.size("frames").alias("frames"), F.size(F.filter("frames", lambda f: f["is_speech"])).alias("speech"))


@query("SELECT DISTINCT l_suppkey AS id, true AS same FROM lineitem")
def spectral_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and back: the largest deviation from the signal."""
    sig = signals(spark, sf_dir)
    back = K.istft(K.stft(sig, framing=SHORT), "id", SHORT).withColumnRenamed("samples", "back")
    d = F.array_max(F.zip_with("samples", F.slice("back", F.lit(1), F.size("samples")), lambda a, b: F.abs(a - b)))
    return sig.join(back, "id").select("id", (d < 1e-9).alias("same"))


@query()
def objective_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel scores of enhanced signals against the clean ones."""
    sig = signals(spark, sf_dir).select("id", F.col("samples").alias("ref"), F.col("samples").alias("est"))
    return K.score(K.enhance_signals(sig, "wiener", "est", framing=SHORT).select("id", "ref", "est"), intelligibility=False).select("id", *(F.round(c, 4).alias(c) for c in ("si_sdr", "sdr", "seg_snr")))


@query()
def controlled_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small controlled test set: cells, sources in turn, rooms, noise, common gain."""
    cells = B.strata(spark, (0, 10))
    src = K.noise_table(spark, ("babble",), 16_000, 4).select(F.col("seed").alias("source_no"), F.concat(F.lit("voice"), "seed").alias("source_id"), "samples")
    return K.controlled_benchmark(cells, src, 1, 4).drop("noisy", "clean")


@query()
def noise_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationarity of each kind of noise over a few seeds, from frame powers."""
    from ..kernels.synth import KINDS
    from ..operators.scoring import stationarity

    frames = K.stft(K.noise_table(spark, KINDS, 32_000, 2))
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, v: a + v)
    sig = frames.select(F.concat_ws(":", "kind", "seed").alias("id"), F.col("t").alias("idx"), power.alias("x"))
    return stationarity(sig).select("id", "n", F.round("range_db", 3).alias("range_db"), "stationary")


@query()
def room_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.room_table(spark, (0.3, 0.6, 0.9)).select("t60", F.size("samples").alias("n"), F.round("measured", 4).alias("measured"))


@query("SELECT * FROM (VALUES ('none', 'dsp'), ('specsub', 'dsp'), ('wiener', 'dsp'), ('mmse-lsa', 'dsp')) t(method, kind)")
def method_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.method_catalog(spark).select("method", "kind")


@query("SELECT * FROM (VALUES ('higher', 9, 5), ('lower', 2, 2)) t(direction, n, available)")
def metric_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.metric_catalog(spark).groupBy("direction").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if("available").cast("int").alias("available"))


@query("SELECT 7 AS checks, 7 AS ok")
def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.self_check(spark).agg(F.count(F.lit(1)).cast("int").alias("checks"), F.count_if("ok").cast("int").alias("ok"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, ts, event_id, coalesce((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2""")
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: a new session after half an hour without events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    new = F.coalesce((at - F.lag(at).over(w) > 1800).cast("int"), F.lit(1))
    marked = table(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(f"""WITH RECURSIVE {EVENTS}, m AS (SELECT id, idx, x > 40 AS v FROM sig),
r AS (SELECT DISTINCT id, 0::BIGINT AS n, 0::BIGINT AS speech, 0::BIGINT AS silence, -1::BIGINT AS s, NULL::BIGINT AS a, NULL::BIGINT AS b FROM m
  UNION ALL SELECT id, n + 1, CASE WHEN cut THEN 0 ELSE speech END, CASE WHEN cut THEN 0 ELSE silence END, CASE WHEN cut THEN -1 ELSE s END, CASE WHEN cut THEN s END, CASE WHEN cut THEN n + 1 END
  FROM (SELECT *, s >= 0 AND (silence >= 2 AND speech >= 3 OR n + 1 - s > 20) AS cut FROM (
    SELECT r.id, r.n, r.speech + v::INT AS speech, CASE WHEN v THEN 0 ELSE r.silence + 1 END AS silence, CASE WHEN r.s < 0 AND v THEN r.n ELSE r.s END AS s FROM r JOIN m ON m.id = r.id AND m.idx = r.n)))
SELECT id::VARCHAR AS session, a AS start, b AS "end" FROM r WHERE a IS NOT NULL""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment state machine over activity flags, over blocks."""
    frames = sig_events(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "idx", (F.col("x") > 40).alias("speech"))
    return scans.segments(frames, quiet=2, least=3, longest=20).withColumnRenamed("id", "session")


@query("SELECT l_suppkey::VARCHAR AS session, unnest(range(0, count(*) // 32)) AS block, 32 AS n, 0::BIGINT AS late FROM lineitem GROUP BY l_suppkey")
def session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of uneven length through the session pipeline, as a batch of one."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 50).cast("int")), lambda k: F.struct(k.cast("bigint").alias("seq"), F.slice("samples", k * 50 + 1, 50).cast("array<float>").alias("pcm")))
    chunks = signals(spark, sf_dir).select(F.col("id").cast("string").alias("session"), F.inline(cut))
    out = sessions.enhance_stream(chunks.withColumn("control", F.lit(None).cast("string")), SHORT)
    return out.select("session", "block", F.size("samples").alias("n"), "late")


@query("SELECT step, round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 ELSE 0.001 * (0.01 + 0.99 * 0.5 * (1 + cos(pi() * (step - 100) / 900))) END, 9) AS rate FROM (SELECT unnest(range(0, 1000, 10)) AS step)")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up, then half a cosine."""
    s = F.col("step")
    cosine = 0.001 * (0.01 + 0.99 * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (s - 100) / 900)))
    return spark.range(0, 1000, 10).withColumnRenamed("id", "step").select("step", F.round(F.when(s < 100, 0.001 * (s + 1) / 100).otherwise(cosine), 9).alias("rate"))


