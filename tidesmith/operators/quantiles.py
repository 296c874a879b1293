"""Exact quantiles: of sliding windows by sorted blocks with counts, of groups of any size by refining histograms.

Quantiles lie between neighbouring values, in proportion, as those of the
built-in percentile. Null and NaN values are left out; without any value a
quantile is null. Ties are values like others. An empty table gives an empty one.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of a sliding window; values of a sorted block; values that one task sorts; pivots of a round.
BLOCK, LOAD, LIMIT, PIVOTS = 8192, 256, 100_000, 64
#: Brackets that may be broadcast; more are joined by a shuffle.
BROADCAST = 50_000


def settled(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder of spark.checkpoint.dir; in a temporary one only where none is set and all run on this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidesmith-"))
    return df.checkpoint()


class Sorted:
    """Values in order, in blocks of bounded size with their counts: adding, removing and reading by rank cost about the same for any number of values."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.last: list[float] = []
        self.n = 0

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks, self.last = [[x]], [x]
            return
        k = min(bisect_left(self.last, x), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > 2 * LOAD:
            self.blocks[k : k + 1] = [block[:LOAD], block[LOAD:]]
            self.last[k : k + 1] = [block[LOAD - 1], block[-1]]
        else:
            self.last[k] = block[-1]

    def remove(self, x: float) -> None:
        self.n -= 1
        k = bisect_left(self.last, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        if block:
            self.last[k] = block[-1]
        else:
            del self.blocks[k], self.last[k]

    def at(self, rank: int) -> float:
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)

    def quantile(self, q: float) -> float | None:
        if not self.n:
            return None
        place = q * (self.n - 1)
        low = int(place)
        a = self.at(low)
        if place == low:
            return a
        return (low + 1 - place) * a + (place - low) * self.at(low + 1)


def sliding(rows: DataFrame, value: Column, quantiles: Sequence[float], before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """(id, idx, q): for each row the quantiles of the rows from `before` before it to `after` behind it; idx counts an id's rows from 0 without gaps.

    An id is cut into blocks that overlap by the window, so a long one is many tasks' work.
    """
    size = max(block, before + after + 1)
    first, last = (F.floor(x / size).cast("bigint") for x in (F.col("idx") - after, F.col("idx") + before))
    held = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    dealt = rows.select(F.struct("id").alias("who"), "idx", held.alias("x"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block"))
    wide = dealt.groupBy("who", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                v, start = b.column("v")[i].values, b.column("block")[i].as_py() * size
                idx, x = v.field("idx").to_numpy(), v.field("x").to_pylist()
                window, out, begin, end = Sorted(), [], 0, 0
                own = np.flatnonzero((idx >= start) & (idx < start + size)).tolist()
                for k in own:
                    while end < len(x) and idx[end] <= idx[k] + after:
                        if x[end] is not None:
                            window.add(x[end])
                        end += 1
                    while idx[begin] < idx[k] - before:
                        if x[begin] is not None:
                            window.remove(x[begin])
                        begin += 1
                    out.append([window.quantile(q) for q in quantiles])
                if own:
                    yield pa.RecordBatch.from_arrays([b.column("who").take(pa.array([i] * len(own))), pa.array(idx[own]), pa.array(out, pa.list_(pa.float64()))], names=["who", "idx", "q"])

    kind = T.StructType([T.StructField("who", T.StructType([rows.schema["id"]])), T.StructField("idx", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
    return wide.mapInArrow(run, kind).select("who.id", "idx", "q")


def _beside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """rows (who, x) with the brackets of their group in which they lie."""
    small = brackets.count() <= BROADCAST
    met = rows.join(F.broadcast(brackets) if small else brackets, "who")
    return met.filter((F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high"))))


def _narrowed(rows: DataFrame, brackets: DataFrame, pivots: int) -> DataFrame:
    """Brackets (who, rank, low, high, below, inside, answer) after one round: pivots of about equal counts, exact counts between and at them, and the cell that holds the rank."""
    shares = F.array(*(F.lit((k + 1) / (pivots + 1)) for k in range(pivots)))
    cuts = _beside(rows, brackets).groupBy("who", "rank").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", shares, F.lit(20 * pivots)))).alias("cuts"))
    known = brackets.join(cuts, ["who", "rank"])
    known = settled(known)
    # cells are counted: 2 k between the pivots k - 1 and k, 2 k + 1 at pivot k
    cell = 2 * F.size(F.filter("cuts", lambda p: p < F.col("x"))) + F.array_contains("cuts", F.col("x")).cast("int")
    counts = _beside(rows, known).groupBy("who", "rank", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("who", "rank").orderBy("cell"))
    found = counts.withColumn("upto", upto).join(known, ["who", "rank"]).filter((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("n") <= F.col("rank")))
    k = F.floor(F.col("cell") / 2).cast("int")
    return found.select("who", "rank", F.coalesce(F.get("cuts", k - 1), "low").alias("low"), F.coalesce(F.get("cuts", k), "high").alias("high"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"), F.when(F.col("cell") % 2 == 1, F.get("cuts", k)).alias("answer"))


def grouped(rows: DataFrame, by: str, value: Column, quantiles: Sequence[float], limit: int = LIMIT, pivots: int = PIVOTS) -> DataFrame:
    """(by, q): the quantiles of each group that has a value.

    Groups of up to `limit` values are sorted by the task that has them. For a
    larger one every rank that is asked for has a bracket of values, narrowed in
    rounds: sketches give pivots, exact counts say which cell has the rank. Sketch
    and counts are summed up before they are shuffled, so a group's rows stay
    where they are, and a round divides a bracket by about `pivots`; equal
    values meet in a cell of their own and end it. What is left of a bracket,
    `limit` values at most, is sorted.
    """
    x = value.cast("double")
    held = rows.select(F.struct(F.col(by)).alias("who"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    large = held.groupBy("who").agg(F.count(F.lit(1)).alias("inside")).filter(F.col("inside") > limit)
    large = settled(large)
    percentile = F.percentile("x", F.array(*map(F.lit, quantiles)))
    n_large = large.count()
    if not n_large:
        return held.groupBy("who").agg(percentile.alias("q")).select(f"who.{by}", "q")
    apart = F.broadcast(large) if n_large <= BROADCAST else large
    small = held.join(apart, "who", "left_anti").groupBy("who").agg(percentile.alias("q"))
    held = held.join(apart.select("who"), "who", "left_semi")
    place = lambda q: (F.col("inside").cast("double") - 1) * q
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in quantiles)))).cast("array<bigint>")
    open_ = F.lit(None).cast("double")
    now = large.select("who", F.explode(ranks).alias("rank"), open_.alias("low"), open_.alias("high"), F.lit(0).cast("bigint").alias("below"), "inside", open_.alias("answer"))
    done = []
    while True:
        now = settled(now)
        ready = F.col("answer").isNotNull() | (F.col("inside") <= limit)
        done.append(now.filter(ready))
        now = now.filter(~ready)
        if now.isEmpty():
            break
        now = _narrowed(held, now, pivots)
    ends = reduce(DataFrame.unionByName, done)
    left = ends.filter("answer IS NULL")
    last = _beside(held, left).groupBy("who", "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("v"))
    values = ends.filter("answer IS NOT NULL").select("who", "rank", "answer").unionByName(last.select("who", "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("answer")))
    by_rank = values.groupBy("who").agg(F.map_from_entries(F.collect_list(F.struct("rank", "answer"))).alias("at")).join(large, "who")

    def between(q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, z = (F.element_at("at", r.cast("bigint")) for r in (low, high))
        return F.when(low == high, a).otherwise((high - place(q)) * a + (place(q) - low) * z)

    return small.unionByName(by_rank.select("who", F.array(*map(between, quantiles)).alias("q"))).select(f"who.{by}", "q")
