"""Queries on transcript normalisation and error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .book import query, table

_PAIRS = "p AS (SELECT conv_id, turn, text AS hyp, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation as reference and hypothesis."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("hyp"), F.lag("text").over(w).alias("ref")).filter("ref IS NOT NULL")


@query()
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an oracle: the engine's distance counts bytes. Tested against brute force."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.cer(F.col("ref"), F.col("hyp")), 6).alias("cer"))


@query()
def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the rates of the utterances, not the rate of all characters."""
    return _pairs(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.cer(F.col("ref"), F.col("hyp"))), 6).alias("cer"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM p WHERE ref IS NOT NULL),
d AS (SELECT *, list_reduce(list_prepend(range(0, len(h) + 1), list_transform(r, lambda w: [list_position(r, w)::BIGINT])), lambda b, q: list_reduce(list_prepend([b[1] + 1], list_transform(range(1, len(h) + 1), lambda j: [j])), lambda done, j: list_append(done, least(done[-1] + 1, b[j[1] + 1] + 1, b[j[1]] + (h[j[1]] <> r[q[1]])::INT)))) AS e FROM w)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN (len(h) > 0)::INT ELSE e[-1]::DOUBLE / len(r) END, 6) AS wer FROM d""")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


@query(r"SELECT conv_id, turn, lower(regexp_replace(text, '[\p{P}$+<=>^`|~]', '', 'g')) AS plain FROM conversations")
def strip_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(T.strip_punctuation(F.col("text"))).alias("plain"))


@query(r"SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '[\p{P}$+<=>^`|~]', '', 'g')), '\s+', '', 'g') AS cer_text, trim(regexp_replace(lower(regexp_replace(text, '[\p{P}$+<=>^`|~]', '', 'g')), '\s+', ' ', 'g')) AS wer_text FROM conversations")
def normalize_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normalisation; the oracle has the part that these Latin texts need."""
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.for_cer(x).alias("cer_text"), T.for_wer(x).alias("wer_text"))


@query("SELECT doc_id, format('{:05d}_{}_snr{}_{}_rt{:.1f}', doc_id, lang, 5, source, 0.4::DOUBLE) AS name FROM documents")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.benchmark import record_id

    return table(spark, sf_dir, "documents").select("doc_id", record_id(F.col("doc_id"), F.col("lang"), F.lit("5"), F.col("source"), F.lit(0.4)).alias("name"))


@query("SELECT event_id, round(value, 2) AS half_up, round_even(value * 4, 0) AS half_even FROM events")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round("value", 2).alias("half_up"), F.bround(F.col("value") * 4, 0).alias("half_even"))


_SECTION = """list_reduce(list_prepend({{'c': '', 's': 0::BIGINT, 'd': 0::BIGINT}}, list_transform(list_filter(string_split({0}, ''), lambda c: c <> '' AND c NOT IN ('万', '亿')), lambda c: {{'c': c, 's': 0::BIGINT, 'd': 0::BIGINT}})),
  lambda a, x: {{'c': '', 's': a.s + CASE x.c WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 ELSE 0 END * greatest(a.d, 1), 'd': CASE WHEN x.c IN ('十', '百', '千') THEN 0 ELSE instr('零一二三四五六七八九', x.c) - 1 END}})"""


@query(f"""WITH r AS (SELECT o_orderkey, regexp_replace(translate((o_orderkey * 7919 % 99991)::VARCHAR, '0123456789', '零一二三四五六七八九'), '(.)(.)', CASE o_orderkey % 7 WHEN 0 THEN '\\1万\\2' WHEN 1 THEN '\\1千\\2百' WHEN 2 THEN '\\1\\2十' WHEN 3 THEN '亿\\1百\\2' WHEN 4 THEN '\\1十\\2万' WHEN 5 THEN '千\\1亿\\2十' ELSE '\\1\\2' END) AS run FROM orders),
p AS (SELECT *, contains(run, '亿') AS big, CASE WHEN contains(run, '亿') THEN split_part(run, '亿', 1) END AS p8, CASE WHEN contains(run, '亿') THEN substr(run, instr(run, '亿') + 1) ELSE run END AS r8 FROM r),
q AS (SELECT *, CASE WHEN contains(r8, '万') THEN split_part(r8, '万', 1) END AS p4, CASE WHEN contains(r8, '万') THEN substr(r8, instr(r8, '万') + 1) ELSE r8 END AS r4 FROM p),
s AS (SELECT *, {_SECTION.format("coalesce(p8, '')")} AS s8, {_SECTION.format("coalesce(p4, '')")} AS s4, {_SECTION.format("r4")} AS s0 FROM q)
SELECT o_orderkey, 'x' || CASE WHEN regexp_matches(run, '[十百千万亿]') THEN (CASE WHEN p8 IS NULL THEN 0 WHEN p8 = '' THEN 100000000 ELSE 100000000 * (s8.s + s8.d) END + CASE WHEN p4 IS NULL THEN 0 WHEN p4 = '' THEN 10000 ELSE 10000 * (s4.s + s4.d) END + s0.s + s0.d)::VARCHAR
  ELSE translate(run, '零一二三四五六七八九', '0123456789') END || 'y' AS text FROM s""")
def numeral_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys spelt as runs of numerals with units here and there, read back as numbers."""
    k = F.col("o_orderkey")
    spelt = F.translate((k * 7919 % 99991).cast("string"), "0123456789", "零一二三四五六七八九")
    forms = ["$1万$2", "$1千$2百", "$1$2十", "亿$1百$2", "$1十$2万", "千$1亿$2十", "$1$2"]
    # the first two characters only, as the other engine replaces once
    run = F.regexp_replace(spelt, F.lit("^(.)(.)"), F.element_at(F.array(*map(F.lit, forms)), (k % 7).cast("int") + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.arabic_numerals(F.concat(F.lit("x"), run, F.lit("y"))).alias("text"))
