"""Queries on recursions: trackers, smoothers, state machines, gains."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import recursive as R
from ..operators import scans
from .book import query
from .views import EVENTS, sig_events

ATTACK, RELEASE = R.gate_coefficients()
LOW = 10 ** (-18 / 20)
XI = 10**-2.5


def _wide(x: str) -> str:
    return f"wide AS (SELECT id, list({x} ORDER BY idx) AS v FROM sig GROUP BY id)"


def _unnest(values: str) -> str:
    """Rows of a list column with their places."""
    return f"SELECT id, unnest(range(0, len(s))) AS idx, unnest(s) AS s FROM ({values})"


@query(f"""WITH {EVENTS}, b AS (SELECT *, greatest(floor((idx - 1) / 7.0), 0)::BIGINT AS block FROM sig),
m AS (SELECT id, block + 1 AS block, min(x) AS before FROM b GROUP BY 1, 2)
SELECT id, idx, least(min(x) OVER (PARTITION BY id, block ORDER BY idx), coalesce(before, 1e300)) AS low FROM b LEFT JOIN m USING (id, block)""")
def min_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.min_tracker(sig_events(spark, sf_dir), 7)


@query(f"""WITH {EVENTS}, {_wide('x > 50')},
r AS (SELECT id, list_transform(range(1, len(v) + 1), lambda k: list_reduce(list_transform(v[1:k], lambda q: CASE WHEN q THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END),
  lambda g, t: CASE WHEN t > g THEN {ATTACK!r} * g + (1 - {ATTACK!r}) * t ELSE {RELEASE!r} * g + (1 - {RELEASE!r}) * t END, 1.0::DOUBLE)) AS s FROM wide)
SELECT id, idx, round(s, 8) AS gate FROM ({_unnest('SELECT id, s FROM r')})""")
def gate_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.gate(sig_events(spark, sf_dir), F.col("x") > 50).withColumn("gate", F.round("gate", 8))


@query(f"""WITH {EVENTS}, l AS (SELECT id, idx, 20 * log10(greatest(x, 1e-12) / 100) AS x FROM sig), k AS (SELECT id, list(x ORDER BY idx) FILTER (x > -20) AS v FROM l GROUP BY id)
SELECT id, round(list_reduce(v, lambda a, x: 0.92 * a + 0.08 * x), 6) AS level_db FROM k WHERE v IS NOT NULL""")
def level_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = scans.level(sig_events(spark, sf_dir), X.db(F.col("x")) - 40, least_db=-20.0)
    return states.groupBy("id").agg(F.round(F.max_by("level", "idx"), 6).alias("level_db")).filter("level_db IS NOT NULL")


@query(f"""WITH RECURSIVE {EVENTS}, r AS (
  SELECT id, idx, CASE WHEN x > 60 THEN 1 ELSE 0 END AS onset, 0 AS hang, false AS active FROM sig WHERE idx = 0
  UNION ALL
  SELECT s.id, s.idx, CASE WHEN s.x > 60 THEN r.onset + 1 ELSE 0 END,
    CASE WHEN s.x > 60 AND r.onset + 1 >= 2 THEN 12 WHEN s.x <= 60 AND r.hang > 0 THEN r.hang - 1 ELSE r.hang END,
    CASE WHEN s.x > 60 AND r.onset + 1 >= 2 THEN true WHEN s.x <= 60 AND r.hang <= 0 THEN false ELSE r.active END
  FROM r JOIN sig s ON s.id = r.id AND s.idx = r.idx + 1)
SELECT id, idx, hang, active FROM r""")
def speech_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.hysteresis(sig_events(spark, sf_dir), F.col("x") > 60)


_SMOOTH = "sm AS (SELECT id, idx, x AS power, avg(x) OVER (PARTITION BY id ORDER BY idx ROWS 3 PRECEDING) AS smooth, min(x) OVER (PARTITION BY id ORDER BY idx ROWS 20 PRECEDING) AS low FROM sig)"


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("idx")
    return sig_events(spark, sf_dir).select("id", "idx", F.col("x").alias("power"), F.avg("x").over(w.rowsBetween(-3, 0)).alias("smooth"), F.min("x").over(w.rowsBetween(-20, 0)).alias("floor"))


@query(f"""WITH RECURSIVE {EVENTS}, {_SMOOTH}, r AS (
  SELECT id, idx, 0.0::DOUBLE AS p, power AS noise FROM sm WHERE idx = 0
  UNION ALL
  SELECT s.id, s.idx, 0.2 * r.p + 0.8 * (s.smooth / greatest(s.low, 1e-12) > 5)::INT,
    (0.95 + 0.05 * (0.2 * r.p + 0.8 * (s.smooth / greatest(s.low, 1e-12) > 5)::INT)) * r.noise + (1 - (0.95 + 0.05 * (0.2 * r.p + 0.8 * (s.smooth / greatest(s.low, 1e-12) > 5)::INT))) * s.power
  FROM r JOIN sm s ON s.id = r.id AND s.idx = r.idx + 1)
SELECT id, idx, round(p, 6) AS p, round(10 * log10(noise), 6) AS noise_db FROM r""")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence-controlled noise averaging; the first frame sets the floor."""
    out = scans.noise(_smooth(spark, sf_dir))
    return out.select("id", "idx", F.round("p", 6).alias("p"), F.round(10 * X.log10(F.col("noise")), 6).alias("noise_db"))


@query(f"""WITH RECURSIVE {EVENTS}, {_SMOOTH}, g AS (SELECT id, idx, power / (smooth + 1e-12) AS gamma FROM sm),
r AS (
  SELECT id, idx, gamma, least(greatest(greatest(greatest(gamma - 1, 0), {XI!r}) / (1 + greatest(greatest(gamma - 1, 0), {XI!r})), {LOW!r}), 1) AS gain FROM g WHERE idx = 0
  UNION ALL
  SELECT q.id, q.idx, q.gamma, least(greatest(q.xi / (1 + q.xi), {LOW!r}), 1) FROM (
    SELECT g.id, g.idx, g.gamma, greatest(0.98 * r.gain * r.gain * r.gamma + 0.02 * greatest(g.gamma - 1, 0), {XI!r}) AS xi FROM r JOIN g ON g.id = r.id AND g.idx = r.idx + 1) q)
SELECT id, idx, round(gain, 6) AS gain FROM r""")
def wiener_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct("power", F.col("smooth").alias("noise"))
    out = R.states(_smooth(spark, sf_dir), v, F.expr("named_struct('gain', 1D, 'gamma', 0D, 'first', true)"), R.wiener_step())
    return out.select("id", "idx", F.round("state.gain", 6).alias("gain"))


_SNR = "snr AS (SELECT *, 10 * log10((power + 1e-12) / (low + 1e-12)) AS db FROM sm)"


@query(f"""WITH {EVENTS}, {_SMOOTH}, {_SNR}
SELECT id, idx, round(least(greatest(sqrt(greatest(power - (4 - 0.15 * least(greatest(db, -5), 20)) * low, 0.02 * low) / (power + 1e-12)), {LOW!r}), 1), 6) AS gain FROM snr""")
def subtraction_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    snr = 10 * F.log10((F.col("power") + 1e-12) / (F.col("floor") + 1e-12))
    return s.select("id", "idx", F.round(R.subtraction_gain(F.col("power"), F.col("floor"), snr), 6).alias("gain"))


@query(f"""WITH {EVENTS}, {_SMOOTH}, {_SNR}, g AS (SELECT *, least(greatest(power / (power + smooth + 1e-12), {LOW!r}), 1) AS g, least(greatest((db - 2) / 12, 0), 1) AS t FROM snr)
SELECT id, idx, round(g + (1 - g) * t, 6) AS gain FROM g""")
def gain_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    snr = 10 * F.log10((F.col("power") + 1e-12) / (F.col("floor") + 1e-12))
    gain = F.least(F.greatest(F.col("power") / (F.col("power") + F.col("smooth") + 1e-12), F.lit(LOW)), F.lit(1.0))
    return s.select("id", "idx", F.round(R.backoff(gain, snr), 6).alias("gain"))


@query(f"""WITH {EVENTS}, {_SMOOTH}, n AS (SELECT id, idx, power / (smooth + 1e-12) AS gamma, greatest(power / (smooth + 1e-12) - 1, {XI!r}) AS xi FROM sm),
v AS (SELECT id, idx, xi, least(greatest(xi * gamma / (1 + xi), 1e-8), 500) AS nu FROM n)
SELECT id, idx, round(least(greatest(xi / (1 + xi) * exp(0.5 * CASE WHEN nu < 0.1 THEN -2.3 * log10(nu) - 0.6 WHEN nu < 1 THEN -1.544 * log10(nu) + 0.166 ELSE pow(10, -0.53 * nu - 0.26) END), {LOW!r}), 1), 6) AS gain FROM v""")
def log_spectral_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-spectral amplitude gain of a frame by itself."""
    gamma = F.col("power") / (F.col("smooth") + 1e-12)
    xi = F.greatest(gamma - 1, F.lit(XI))
    nu = F.least(F.greatest(xi * gamma / (1 + xi), F.lit(1e-8)), F.lit(500.0))
    gain = F.least(F.greatest(xi / (1 + xi) * F.exp(X.half_exp1(nu)), F.lit(LOW)), F.lit(1.0))
    return _smooth(spark, sf_dir).select("id", "idx", F.round(gain, 6).alias("gain"))


