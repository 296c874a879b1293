"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: the
vector of each is permuted (rolled) by its place and the results are
multiplied. A text bundles (adds) the vectors of all its n-grams; a language's
prototype bundles those of its sample texts, each scaled to length 1. The
language whose prototype has the largest cosine with the text's vector is
predicted, and that cosine, at least 0, is the score.

A null text and one without letters are `und` with score 0. Upper and lower
case are alike; every run of other characters is one gap sign. Texts of any
length are read whole. Ties go to the language first in order. Without any
text to learn from, all are `und`. Rows are judged one by one, so repeated rows
are judged alike; extra columns are untouched, but for result names, which are
replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_arrow, crc_mod, named, rows_by_batch, slim, table

GRAM = 3


class Letters:
    """Random vectors for letters, drawn from the code point alone, so that every worker has the same."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.drawn: dict[int, np.ndarray] = {}
        self.kind = np.full(0x110000, -1, np.int8)  # 1 letter, 0 other, -1 not met

    def vectors(self, points: np.ndarray) -> np.ndarray:
        return np.array([self._one(int(c)) for c in points]).reshape(len(points), self.dimensions)

    def _one(self, point: int) -> np.ndarray:
        if point not in self.drawn:
            self.drawn[point] = np.random.default_rng([11, point]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.drawn[point]

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Which code points are letters."""
        kind = self.kind[points]
        if (kind < 0).any():
            new = np.unique(points[kind < 0])
            self.kind[new] = [unicodedata.category(chr(c))[0] == "L" for c in new]
            kind = self.kind[points]
        return kind == 1


def bundle(texts: list[str], letters: Letters) -> np.ndarray:
    """One vector (float32) for each text; zeros for a text without letters."""
    flat = np.frombuffer("\0".join(["", *(f" {t.lower()} " for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters.letters(flat)
    ends = flat == 0  # a NUL inside a text would read as a border; it is a gap there
    if int(ends.sum()) != len(texts) + 1:
        return bundle([t.replace("\0", " ") for t in texts], letters)
    keep = is_letter | ends | np.concatenate(([True], is_letter[:-1] | ends[:-1]))  # of a run of gaps the first stays
    points = np.where(is_letter, flat, np.where(ends, 0, 32))[keep]
    text_of = np.cumsum(points == 0) - 1
    signs, place = np.unique(points, return_inverse=True)
    m = len(signs)
    n = len(points) - GRAM + 1
    code = np.zeros(max(n, 0), np.int64)
    valid = np.ones(max(n, 0), bool)
    for i in range(GRAM):
        code = code * m + place[i : n + i]
        valid &= points[i : n + i] != 0
    valid &= points[1 : n + 1] != 32  # an n-gram has its gap at an end
    code, owner = code[valid], text_of[:n][valid]
    grams, column = np.unique(code, return_inverse=True) if m**GRAM > 4_000_000 else _dense_unique(code, m**GRAM)
    out = np.zeros((len(texts), letters.dimensions), np.float32)
    base = letters.vectors(signs)
    for a in range(0, len(grams), 2048):  # so that the bound n-grams and the counts need little memory
        z = min(a + 2048, len(grams))
        bound = np.ones((z - a, letters.dimensions), np.int8)
        part = grams[a:z]
        for i in range(GRAM):
            sign = part // m ** (GRAM - 1 - i) % m
            bound *= np.roll(base, GRAM - 1 - i, axis=1)[sign]
        mine = (column >= a) & (column < z) if z - a < len(grams) else slice(None)
        counts = np.bincount(owner[mine] * (z - a) + column[mine] - a, minlength=len(texts) * (z - a)).reshape(len(texts), z - a)
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _dense_unique(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    met = np.zeros(n, bool)
    met[code] = True
    grams = np.flatnonzero(met)
    return grams, (np.cumsum(met) - 1)[code]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1, keepdims=True))
    return x / np.maximum(size, 1e-12)


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 1000, dimensions: int = 1024) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from about `per_language` rows of each, chosen by a hash of the text."""
    known = labelled.select(named(lang).alias("lang"), named(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, dimensions))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.filter(draw < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(dimensions), {}
        for b in rows_by_batch(batches, 1 << 18):
            units = _unit(bundle(b.column("text").to_pylist(), letters))
            for k, v in zip(b.column("lang").to_pylist(), units, strict=True):
                total[k] = total.get(k, 0) + v
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": pa.array([np.asarray(v, np.float64) for v in total.values()], pa.list_(pa.float64()))})

    # partial bundles are added up element by element, so that the driver gets one a language
    added = rows.mapInArrow(slim(run), "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum(F.round("col", 9).cast("decimal(28,9)")).cast("double").alias("x"))
    found = {r["lang"]: [v["x"] for v in sorted(r["v"], key=lambda v: v["pos"])] for r in added.groupBy("lang").agg(F.collect_list(F.struct("pos", "x")).alias("v")).collect()}
    names = sorted(found)
    return names, _unit(np.array([found[k] for k in names]))


def language_id(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    stay = [c for c in docs.columns if c not in ("lang_pred", "score")]
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, profiles = Letters(dimensions), prototypes.T.astype(np.float32)
        for b in rows_by_batch(batches, 1 << 18, text):
            vectors = bundle([t or "" for t in b.column(text).to_pylist()], letters)
            size = np.sqrt((vectors**2).sum(axis=1))
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if names:
                cosine = (vectors @ profiles) / np.maximum(size, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                lang = [names[k] if s > 0 else "und" for k, s in zip(best, size, strict=True)]
                score = np.where(size > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*stay, "lang_pred", "score"])

    return by_arrow(docs, run, [*(docs.schema[c] for c in stay), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = fit_profiles(docs.filter(~held_out()))
    return language_id(docs.select("doc_id", "text"), names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
