"""Quality rules as a short-circuit cascade.

A rule rejects a text by features of it. On a sample of rows each rule's cost
(seconds a text, with the features it is first to need) and selectivity (share
rejected) are measured; rules then run in order of rejection per cost, each on
the texts that all earlier ones let pass. A text is kept if no rule rejects
it, so the order changes the work and never the verdict.

Null or empty text: every count is 0, and the rule on word counts rejects it.
Repeated rows are judged alike, one by one. An empty table gives an empty one.
Extra columns stay untouched, but for those that bear the names of results,
which the results replace.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_arrow, named, rows_by_batch, table
from .wordscan import SPACE, Scan

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _word_chars(s: Scan) -> np.ndarray:
    return s.per_text(~s.space & ((s.data & 0xC0) != 0x80))


def _dup_lines(s: Scan) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    of, h, size = s.lines
    order = np.lexsort((size, h, of))
    of, h, size = of[order], h[order], size[order]
    same = (of[1:] == of[:-1]) & (h[1:] == h[:-1]) & (size[1:] == size[:-1])
    return np.bincount(of[1:][same], minlength=s.n)


def _repeat_words(s: Scan, width: int = 3) -> np.ndarray:
    """Words that lie in a window of three words found twice or more in the text."""
    at, h = s.windows(width)
    if not len(at):
        return np.zeros(s.n, np.int64)
    of = s.word_text[at]
    order = np.lexsort((h, of))
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(s.word_text), bool)
    for i in range(width):
        covered[at[twice] + i] = True
    return np.bincount(s.word_text[covered], minlength=s.n)


FEATURES: dict[str, Callable[[Scan], np.ndarray]] = {
    "n_words": lambda s: s.n_words,
    "word_chars": _word_chars,
    "n_symbols": lambda s: s.per_text(SYMBOL[s.data]),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda s: np.bincount(s.lines[0], minlength=s.n),
    "n_repeat_words": _repeat_words,
    "n_upper": lambda s: s.per_text((s.data >= 65) & (s.data <= 90)),
    "n_exclaim": lambda s: s.per_text(s.data == 33),
}


@dataclass(frozen=True)
class Rule:
    """rejects: gets arrays of the named features, gives a mask of the texts to reject."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: 2 * c < 5 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 12 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda y, n: 10 * y > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 40 * n),
    Rule("capitals", ("n_upper", "word_chars"), lambda u, c: 100 * u > 30 * c),
    Rule("exclamations", ("n_exclaim", "n_words"), lambda e, n: 4 * e > n),
)
BASE_RULES = ("few_words", "repeated_words")
BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(texts: pa.Array, rules: Sequence[Rule], report: Sequence[str] = (), tally: dict[str, list[float]] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features to report for all texts, the kept mask, and how many rules each text met.

    tally: gets (texts met, texts rejected, seconds) by rule; then no rule is spared a text.
    """
    scan = Scan(texts)
    known = {f: FEATURES[f](scan) for f in report}
    alive, met = np.arange(scan.n), np.zeros(scan.n, np.int64)
    own, have = scan, dict(known)
    rejected = np.zeros(scan.n, bool)
    for rule in rules:
        if not len(alive) and tally is None:
            break
        began = time.perf_counter()
        for f in rule.needs:
            if f not in have:
                have[f] = FEATURES[f](own)
        out = np.asarray(rule.rejects(*(have[f] for f in rule.needs)), bool)
        if tally is not None:
            t = tally.setdefault(rule.name, [0, 0, 0.0])
            t[0], t[1], t[2] = t[0] + own.n, t[1] + int(out.sum()), t[2] + time.perf_counter() - began
            rejected |= out
            have = dict(known)  # each rule pays for its own features
            own = Scan(texts)
            continue
        met[alive] += 1
        rejected[alive[out]] = True
        if out.any():
            alive = alive[~out]
            have = {f: x[~out] for f, x in have.items()}
            own = Scan(texts.take(pa.array(alive)))
    return known, ~rejected, met


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 512, text: str = "text", report: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """Rules by falling rejection per cost, with share rejected and seconds a text, measured on about `sample_rows` rows of the whole table. Features in `report` are there for all texts, and cost a rule nothing."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[float]] = {}
        for b in rows_by_batch(batches):
            cascade(b.column("text"), rules, report, tally)
        names = list(tally)
        yield pa.RecordBatch.from_pydict({"rule": names, "met": [float(tally[r][0]) for r in names], "out": [float(tally[r][1]) for r in names], "s": [tally[r][2] for r in names]})

    share = min(1.0, sample_rows / max(1, docs.count()))
    found = docs.select(named(text).alias("text")).sample(share, seed=7).mapInArrow(measure, "rule string, met double, out double, s double")
    by = {r["rule"]: r for r in found.groupBy("rule").agg(F.sum("met").alias("met"), F.sum("out").alias("out"), F.sum("s").alias("s")).collect()}
    rate = {r.name: ((by[r.name]["out"] / max(by[r.name]["met"], 1), by[r.name]["s"] / max(by[r.name]["met"], 1)) if r.name in by else (0.0, 1.0)) for r in rules}
    return sorted(((r, *rate[r.name]) for r in rules), key=lambda x: -x[1] / max(x[2], 1e-9))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample_rows: int = 512, text: str = "text") -> DataFrame:
    """docs with the reported features, `kept`, and `rules_met` (rules run on the text before its verdict)."""
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows, text, report)]
    names = [*report, "kept", "rules_met"]
    stay = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_by_batch(batches, column=text):
            known, kept, met = cascade(b.column(text), ordered, report)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), *(pa.array(known[f].astype(np.int64)) for f in report), pa.array(kept), pa.array(met)], names=[*stay, *names])

    results = [*(T.StructField(f, T.LongType()) for f in report), T.StructField("kept", T.BooleanType()), T.StructField("rules_met", T.LongType())]
    return by_arrow(docs.select(*map(named, stay)), run, [*(docs.schema[c] for c in stay), *results])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules(docs, report=BASE_FEATURES).select("doc_id", *BASE_FEATURES, failed.alias("base_failed"), "kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n >= 2) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 30 * word_chars OR 4 * n_exclaim > n_words) AS kept
FROM m
"""
