"""Quality classifier by compression.

Whole texts labelled good and whole texts labelled bad become two zstandard
dictionaries. A text is compressed with each, block by block. The difference of
the two sizes over the text's own size, one number, says which dictionary
explains the text, and how much of it: a text that explains itself by repeating
itself needs neither. A logistic curve of that number, fitted on labelled texts that the
dictionaries do not hold, is the score: the calibrated probability of label 1.

Rows are drawn at another rate for each label; weights give them the shares that
the labels have among all labelled rows, so a score does not depend on how many
rows the input has.

Null and empty texts have nothing to compress and no quality: their score is 0.
Long texts are compressed whole, block by block. An id with several labels, or
a text, counts as bad if any of its labels is. Of equal draws, ties, the
smaller text comes first. With labels of one kind only, or none, or too few to
fit a curve, the score of every text with a character is the share of label 1
(0.5 without labels). An empty table gives an empty one. Rows are judged one by
one, so repeated rows are judged alike; extra columns are untouched, but for
result names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_arrow, crc_mod, named, rows_by_batch, slim, table, written

#: Bytes of a text that are compressed at once: short blocks lean on the dictionary.
BLOCK = 512
#: Of its dictionary a text may take one part in so many; a longer one gives pieces of STRIP bytes, spread over it evenly.
PARTS, STRIP = 16, 4096


@dataclass
class Model:
    good: bytes
    bad: bytes
    share: float
    slope: float = 0.0
    start: float = 0.0
    centre: float = 0.0
    spread: float = 1.0
    level: int = 9

    def compressors(self):
        """Those of the good and of the bad dictionary."""
        import zstandard as zs

        params = zs.ZstdCompressionParameters.from_level(self.level, write_content_size=0, write_checksum=0, write_dict_id=0)
        return [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (self.good, self.bad)]

    def score(self, difference: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if not self.spread:  # nothing was fitted
            return np.where(empty, 0.0, self.share)
        # at most 4 spreads from the median: a copy of what a dictionary holds is no more certain than that
        z = self.start + self.slope * np.clip((difference - self.centre) / self.spread, -4, 4)
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def measure(texts: list[str | None], compressors) -> tuple[np.ndarray, np.ndarray]:
    """The normalised difference of the compressed sizes of each text, (bad - good) / bytes, and which texts are empty."""
    out, empty = np.zeros(len(texts)), np.zeros(len(texts), bool)
    good, bad = (c.compress for c in compressors)
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if not data:
            empty[i] = True
            continue
        g = b = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            g, b = g + len(good(block)), b + len(bad(block))
        out[i] = (b - g) / len(data)
    return out, empty


def strips(data: bytes, most: int) -> bytes:
    """At most `most` bytes of a text: all of it, or pieces from its beginning to its end."""
    if len(data) <= most:
        return data
    n = max(1, most // STRIP)
    size, step = most // n, len(data) / n
    return b"".join(data[int(k * step) : int(k * step) + size] for k in range(n))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * h[:, None]) + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", rows: int = 4000, dictionary: int = 2_000_000, level: int = 9, whole: dict[int, int] | None = None) -> Model:
    """A model from a sample of labelled rows: at most about `rows` of each label, drawn by a hash of the text.

    Three quarters of the drawn texts, by another hash, may become dictionary:
    in the order of their draw each that still fits into `dictionary` bytes. A
    text of more than a sixteenth of that gives even pieces of so much in all.
    One label may have more bytes than the other; the curve allows for it. It is
    fitted on the last quarter. `whole` has the rows of each label that `labelled` was
    drawn from, if it is itself a sample; the curve is fitted to their shares.
    """
    known = labelled.filter((F.length(named(text)) > 0) & named(label).isin(0, 1)).groupBy(named(text).alias("text")).agg(F.min(named(label)).cast("int").alias("y"))
    draw = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    known = written(known.withColumn("draw", draw).withColumn("bytes", F.octet_length("text")).withColumn("part", F.pmod(F.xxhash64("text", F.lit(31)), F.lit(4))), "labelled")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = whole or counts
    total = sum(whole.values())
    model = Model(b"", b"", whole.get(1, 0) / total if total else 0.5, spread=0.0, level=level)
    if len(counts) < 2:
        return model
    rates = {y: min(1.0, rows / n) for y, n in counts.items()}
    drawn = known.filter(F.col("draw") < F.when(F.col("y") == 1, rates[1]).otherwise(rates[0]))
    # at most about `rows` rows of a label, without their texts, say which fit
    most = max(1, dictionary // PARTS)
    mark, left, chosen = F.xxhash64("text", F.lit(43)), {0: dictionary, 1: dictionary}, []
    for r in sorted(drawn.filter("part > 0").select("y", "draw", mark.alias("mark"), F.least("bytes", F.lit(most)).alias("bytes")).collect(), key=lambda r: (r["draw"], r["mark"])):
        if r["bytes"] <= left[r["y"]]:
            left[r["y"]] -= r["bytes"]
            chosen.append((r["mark"],))
    if dictionary in left.values():
        return model

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [strips((t or "").encode("utf-8", "surrogatepass"), most) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("draw"), pa.array(data, pa.binary())], names=["y", "draw", "data"])

    fitting = drawn.filter("part > 0").withColumn("mark", mark).join(F.broadcast(known.sparkSession.createDataFrame(chosen, "mark bigint").distinct()), "mark", "left_semi")
    texts = fitting.select("y", "draw", "text").mapInArrow(slim(cut), "y int, draw double, data binary").collect()
    parts = {y: b"\n".join(bytes(r["data"]) for r in sorted(texts, key=lambda r: (-r["draw"], r["data"])) if r["y"] == y) for y in (0, 1)}
    model.good, model.bad = parts[1], parts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            x, _ = measure(b.column("text").to_pylist(), compressors)
            yield pa.RecordBatch.from_arrays([pa.array(x), b.column("y")], names=["x", "y"])

    found = sorted(tuple(r) for r in drawn.filter("part = 0").select("text", "y").mapInArrow(slim(run), "x double, y int").collect())
    if len({y for _, y in found}) == 2:
        x, y = np.array([r[0] for r in found]), np.array([r[1] for r in found], float)
        low, model.centre, high = (float(q) for q in np.quantile(x, (0.1, 0.5, 0.9)))
        model.spread = max((high - low) / 2.56, 1e-6)
        # the rows of its label that a drawn one stands for
        stands = np.where(y == 1, *(whole[k] / (counts[k] * rates[k]) for k in (1, 0)))
        z = np.clip((x - model.centre) / model.spread, -4, 4)
        model.start, model.slope = (float(w) for w in _logistic(np.column_stack([np.ones(len(z)), z]), y, stands / stands.mean()))
    return model


def compression_score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold)."""
    stay = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in rows_by_batch(batches, column=text):
            s = model.score(*measure(b.column(text).to_pylist(), compressors))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*stay, "score", "predicted"])

    return by_arrow(docs, run, [*(docs.schema[c] for c in stay), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """A model from documents outside the held-out part.

    About `rows` labels of each kind are drawn by a hash of the id before they
    meet the documents, so that texts stay where they are. The model's
    probabilities are those of all the labels.
    """
    mine = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in mine.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = F.when(F.col("quality") == 1, min(1.0, rows / counts.get(1, 1))).otherwise(min(1.0, rows / counts.get(0, 1)))
    # written: about 2 * rows small rows, which Spark then sees and brings to the texts
    drawn = written(mine.filter(draw < wanted), "drawn")
    return fit(docs.select("doc_id", "text").join(drawn, "doc_id"), rows=rows, whole=counts)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return compression_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
