"""Queries on scoring aggregates and signal statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import quantiles as Q
from ..operators import scoring as S
from .book import query, table
from .views import EVENTS, LINES, PAIRS, pair_line, sig_events, sig_line


@query(f"""WITH {PAIRS}, m AS (SELECT id, ref - avg(ref) OVER w AS r, est - avg(est) OVER w AS e FROM pair WINDOW w AS (PARTITION BY id)),
s AS (SELECT id, r, e, sum(e * r) OVER w / (sum(r * r) OVER w + 1e-10) AS s FROM m WINDOW w AS (PARTITION BY id))
SELECT id, round(10 * log10((sum(s * r * s * r) + 1e-10) / (sum((e - s * r) * (e - s * r)) + 1e-10)), 4) AS si_sdr FROM s GROUP BY id""")
def si_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.si_sdr(pair_line(spark, sf_dir)).select("id", F.round("si_sdr", 4).alias("si_sdr"))


@query(f"WITH {PAIRS} SELECT id, round(10 * log10((sum(ref * ref) + 1e-10) / (sum((est - ref) * (est - ref)) + 1e-10)), 4) AS sdr FROM pair GROUP BY id")
def sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sdr(pair_line(spark, sf_dir)).select("id", F.round("sdr", 4).alias("sdr"))


def _seg_snr_sql(pairs: str, frame: int, hop: int) -> str:
    return f"""WITH {pairs}, n AS (SELECT id, count(*) AS n, avg(ref * ref) * 1e-4 AS gate FROM pair GROUP BY id),
t AS (SELECT id, gate, unnest(range(0, greatest((n - {frame}) // {hop} + 1, 1))) AS t FROM n),
f AS (SELECT t.id, t.t, gate, sum(ref * ref) AS s, sum((ref - est) * (ref - est)) AS e FROM t JOIN pair p ON p.id = t.id AND p.idx >= t.t * {hop} AND p.idx < t.t * {hop} + {frame} GROUP BY ALL)
SELECT id, round(avg(CASE WHEN s > 0 THEN least(greatest(10 * log10(CASE WHEN s > 0 THEN s ELSE 1 END / (e + 1e-10)), -10), 35) ELSE -10 END) FILTER (s >= gate), 4) AS seg_snr FROM f GROUP BY id"""


@query(_seg_snr_sql(PAIRS, 64, 32))
def seg_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seg_snr(pair_line(spark, sf_dir), 64, 32).select("id", F.round("seg_snr", 4).alias("seg_snr"))


@query(_seg_snr_sql("pair AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS idx, l_discount AS ref, l_tax AS est FROM lineitem)", 4, 2))
def seg_snr_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts against taxes of an order's lines: signals of 1 to 7 samples, shorter than a frame and silent ones among them. Lines equal in number and part stand as in the files, which the SQL leaves open."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col("l_discount").alias("ref"), F.col("l_tax").alias("est"))
    return S.seg_snr(pairs, 4, 2).select("id", F.round("seg_snr", 4).alias("seg_snr"))


@query(f"""WITH {EVENTS}, n AS (SELECT id, count(*) AS n FROM sig GROUP BY id), t AS (SELECT id, unnest(range(0, (n - 8) // 4 + 1)) AS t FROM n WHERE n >= 8),
e AS (SELECT t.id, t.t, sum(x * x) AS e FROM t JOIN sig s ON s.id = t.id AND s.idx >= t.t * 4 AND s.idx < t.t * 4 + 8 GROUP BY ALL)
SELECT id, t FROM e QUALIFY e >= max(e) OVER (PARTITION BY id) * pow(10, -0.35)""")
def active_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.active_frames(sig_events(spark, sf_dir), 8, 4, -3.5)


@query(f"WITH {PAIRS} SELECT id, round(10 * log10(var_pop(ref) / greatest(var_pop(est - ref), 1e-20)), 4) AS snr FROM pair GROUP BY id")
def measured_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.measured_snr(pair_line(spark, sf_dir)).select("id", F.round("snr", 4).alias("snr"))


@query("""SELECT count(*) AS n_frames, round(sum(value), 2) AS total_ms, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99,
round(max(value), 5) AS max_ms, event_type FROM events GROUP BY event_type""")
def latency_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups that hold all rows: no task sorts more than 2,000 values."""
    out = S.latency(table(spark, sf_dir, "events"), F.col("value"), "event_type", 95.0, 0.016, limit=2000)
    return out.select("event_type", "n_frames", F.round("total_ms", 2).alias("total_ms"), *(F.round(c, 5).alias(c) for c in ("p50", "p95", "p99", "max_ms")))


_EDC = """p AS (SELECT *, max(abs(x)) OVER (PARTITION BY id) AS top FROM sig), s AS (SELECT *, min(idx) FILTER (abs(x) = top) OVER (PARTITION BY id) AS start FROM p),
b AS (SELECT id, idx - start AS idx, sum(x * x) OVER (PARTITION BY id ORDER BY idx DESC) AS rest FROM s WHERE idx >= start),
edc AS (SELECT id, idx, 10 * log10(greatest(rest / max(rest) OVER (PARTITION BY id), 1e-20)) AS edc_db FROM b)"""


@query(f"WITH {EVENTS}, {_EDC} SELECT id, idx, round(edc_db, 5) AS edc_db FROM edc")
def energy_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.energy_decay(sig_events(spark, sf_dir)).select("id", "idx", F.round("edc_db", 5).alias("edc_db"))


@query(f"""WITH {LINES}, {_EDC}, k AS (SELECT *, min(idx) FILTER (edc_db <= -5) OVER (PARTITION BY id) AS a, min(idx) FILTER (edc_db <= -20) OVER (PARTITION BY id) AS z FROM edc),
f AS (SELECT id, regr_slope(edc_db, idx / 16000.0) FILTER (idx >= a AND idx < z) AS slope, count(*) FILTER (idx >= a AND idx < z) AS n FROM k GROUP BY id)
SELECT id, CASE WHEN n >= 2 AND slope < -1e-9 THEN round(-60 / slope, 6) END AS t60 FROM f""")
def decay_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decay_time(S.energy_decay(sig_line(spark, sf_dir)), 16_000, -5, -20).select("id", F.round("t60", 6).alias("t60"))


@query(f"""WITH {EVENTS} SELECT id, count(*) AS n_frames, round(sum(x), 4) AS total_ms, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.95), 5) AS p95, round(quantile_cont(x, 0.99), 5) AS p99,
round(max(x), 5) AS max_ms, round(sum(x) / 1000 / (count(*) * 0.016), 5) AS rtf, quantile_cont(x, 0.99) < 95 AS realtime_ok FROM sig GROUP BY id""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.latency(sig_events(spark, sf_dir), F.col("x"), "id", 95.0, 0.016)
    digits = {"total_ms": 4, "p50": 5, "p95": 5, "p99": 5, "max_ms": 5, "rtf": 5}
    return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns))


@query(f"""WITH {EVENTS}, s AS (SELECT id, idx, 10 * log10(greatest(sum(x) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 0) + 1e-12) AS e FROM sig),
r AS (SELECT id, e - quantile_cont(e, 0.5) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN 31 PRECEDING AND 31 FOLLOWING) AS r FROM s)
SELECT id, count(*) AS n, round(quantile_cont(r, 0.95) - quantile_cont(r, 0.05), 5) AS range_db, count(*) >= 31 AND quantile_cont(r, 0.95) - quantile_cont(r, 0.05) < 9 AS stationary FROM r GROUP BY id""")
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stationarity(sig_events(spark, sf_dir)).withColumn("range_db", F.round("range_db", 5))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e[i] - coalesce(p[i], e[i]), 2)))), 5) AS flux FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, lag(list_transform(embedding, lambda v: v::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each frame from the one before of its label; the first has 0."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    p = e.withColumn("p", F.coalesce(F.lag("e").over(Window.partitionBy("label").orderBy("vec_id")), "e"))
    d = F.aggregate(F.zip_with("e", "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return p.select(F.col("vec_id").alias("id"), F.round(F.sqrt(d), 5).alias("flux"))


@query("SELECT user_id AS id, round(100.0 * count(*) FILTER (value > 50 AND event_type <> 'click') / nullif(count(*) FILTER (value > 50), 0), 4) AS miss_rate FROM events GROUP BY 1")
def miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of true frames (value above 50) that a verdict (clicks) misses."""
    true, heard = F.col("value") > 50, F.col("event_type") == "click"
    rate = 100 * F.count_if(true & ~heard) / F.nullif(F.count_if(true), F.lit(0))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(rate, 4).alias("miss_rate"))


@query("SELECT user_id AS id, round(avg((value > 50)::INT), 6) AS ratio FROM events GROUP BY 1")
def speech_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("ratio"))


@query(f"WITH {EVENTS} SELECT id, min(idx) FILTER (x < 30) AS first_low, min(idx) FILTER (x = top) AS argmax FROM (SELECT *, max(x) OVER (PARTITION BY id) AS top FROM sig) GROUP BY id")
def first_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First index under a bound, and the first of the largest."""
    top = sig_events(spark, sf_dir).withColumn("top", F.max("x").over(Window.partitionBy("id")))
    return top.groupBy("id").agg(F.min(F.when(F.col("x") < 30, F.col("idx"))).alias("first_low"), F.min(F.when(F.col("x") == F.col("top"), F.col("idx"))).alias("argmax"))


@query(f"WITH {EVENTS} SELECT id, idx, round(sum(x) OVER w5 / 5, 5) AS mean5, round(quantile_cont(x, 0.5) OVER w63, 5) AS median63, round(x - lag(x) OVER (PARTITION BY id ORDER BY idx), 5) AS diff, max(x) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM sig WINDOW w5 AS (PARTITION BY id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), w63 AS (PARTITION BY id ORDER BY idx ROWS BETWEEN 31 PRECEDING AND 31 FOLLOWING)")
def moving_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("idx")
    x, sig = F.col("x"), sig_events(spark, sf_dir)
    medians = Q.sliding(sig, x, (0.5,), 31, 31).select("id", "idx", F.round(F.col("q")[0], 5).alias("median63"))
    rest = sig.select(
        "id", "idx", F.round(F.sum(x).over(w.rowsBetween(-2, 2)) / 5, 5).alias("mean5"), F.round(x - F.lag(x).over(w), 5).alias("diff"),
        F.max(x).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("best_before"),
    )
    return rest.join(medians, ["id", "idx"])


@query(f"WITH {EVENTS} SELECT id, idx, round(quantile_cont(x, 0.5) OVER w, 5) AS p50, round(quantile_cont(x, 0.95) OVER w, 5) AS p95, round(quantile_cont(x, 0.99) OVER w, 5) AS p99 FROM sig WINDOW w AS (PARTITION BY id ORDER BY idx ROWS 399 PRECEDING)")
def rolling_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.sliding(sig_events(spark, sf_dir), F.col("x"), (0.5, 0.95, 0.99), 399)
    return out.select("id", "idx", *(F.round(F.col("q")[k], 5).alias(n) for k, n in enumerate(("p50", "p95", "p99"))))


@query(f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM sig), q AS (SELECT *, lag(x, 3) OVER (PARTITION BY id ORDER BY idx) AS noise FROM n),
p AS (SELECT id, var_pop(x) AS ps, var_pop(coalesce(noise, 0)) AS pn, avg(coalesce(noise, 0)) AS dc FROM q GROUP BY id)
SELECT q.id, q.idx, round(x + (coalesce(noise, 0) - dc) * sqrt(ps / (pn * pow(10, 0.5))), 5) AS mixed FROM q JOIN p USING (id)""")
def mix_at_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes a signal with noise (its own echo here) at 5 dB; the noise loses its mean first."""
    w = Window.partitionBy("id").orderBy("idx")
    q = sig_events(spark, sf_dir).withColumn("noise", F.coalesce(F.lag("x", 3).over(w), F.lit(0.0)))
    wide = q.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "noise"))).alias("s")).select("id", F.col("s.x").alias("speech"), F.col("s.noise").alias("noise"))
    mixed = K.mix_signals(wide, 5.0, active_only=False).select("id", F.posexplode("mixed"))
    return mixed.select("id", F.col("pos").cast("bigint").alias("idx"), F.round("col", 5).alias("mixed"))


@query(f"WITH {PAIRS}, g AS (SELECT *, least(1, 60000 / max(greatest(abs(ref), abs(est))) OVER (PARTITION BY id)) AS gain FROM pair) SELECT id, idx, round(ref * gain, 4) AS target, round(est * gain, 4) AS input FROM g")
def aligned_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gain for input and target, so that neither clips."""
    gain = F.least(F.lit(1.0), 60_000 / F.max(F.greatest(F.abs("ref"), F.abs("est"))).over(Window.partitionBy("id")))
    return pair_line(spark, sf_dir).withColumn("g", gain).select("id", "idx", F.round(F.col("ref") * F.col("g"), 4).alias("target"), F.round(F.col("est") * F.col("g"), 4).alias("input"))
