"""Bootstrap intervals with a generator that tasks jump ahead in.

The published intervals draw indices with numpy's default generator, in one
stream. That stream is cut into chunks: a task advances a generator of its own
to its chunk, takes the raw numbers there, and from each, by itself, follows
whether the bounded draw accepts it and which index it gives. How many each
chunk accepts, summed up, says which resample and place a draw belongs to. So
the numbers are those of the one stream for any number of tasks, and no group
is one task's work: its values are looked up by rank in blocks, and tasks give
partial sums of resamples. A task holds one block of values, which reaches it in
small pieces, and a slice of draws at a time, however large groups are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluation import finite
from .quantiles import settled

SEED = 20260818
#: Least draws of a chunk, and values of a block.
DRAWS, BLOCK = 1 << 18, 1 << 20
#: Draws held at once, values of a piece of a block, and most tasks that share a block's chunks.
SLICE, PIECE, PARTS = 1 << 18, 256, 16


def slices(seed: int, n: int, chunk: int, draws: int, most: int = SLICE) -> Iterator[np.ndarray]:
    """The indices below n, of numpy's stream of bounded draws, that the raw numbers of one chunk give, of at most `most` raw numbers' halves at a time. A raw number has two halves, the low one first; draws and most are even."""
    generator = np.random.PCG64(seed)
    generator.advance(chunk * draws // 2)
    for a in range(0, draws, most):
        size = min(most, draws - a)
        if n == 1:
            yield np.zeros(size, np.int64)
            continue
        product = generator.random_raw(size // 2).astype("<u8").view("<u4").astype(np.uint64) * np.uint64(n)
        yield (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def accepted(seed: int, n: int, chunk: int, draws: int) -> np.ndarray:
    """All the indices of a chunk."""
    return np.concatenate([np.empty(0, np.int64), *slices(seed, n, chunk, draws)])


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows (who, x, order) with their ranks in their group, from 0: ranges are sorted one by one and the ranges' counts before added, so no task has a whole group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settled(rows.repartitionByRange(parts, "who", order, "x").sortWithinPartitions("who", order, "x").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = laid.groupBy("who", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("who").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.join(sizes.withColumn("_before", before), ["who", "_part"]).select("who", "x", (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"))


def bootstrap(rows: DataFrame, by: str, value: str, order: str, resamples: int = 2000, seed: int = SEED, draws: int = DRAWS, block: int = BLOCK) -> DataFrame:
    """(by, n, mean, low, high): the mean of a group's finite values in the order of `order`, ties by value, and its 95 % interval over resamples of n draws each.

    Null and non-finite values are left out; a group without others has n = 0 and
    nulls. Groups have fewer than 2^32 values. An empty table gives an empty one.
    """
    x = F.col(value).cast("double")
    held = rows.select(F.struct(F.col(by)).alias("who"), F.col(order).alias("_order"), finite(x).alias("x"))
    sizes = settled(held.groupBy("who").agg(F.count("x").alias("n"), F.avg("x").alias("mean")))
    places = ranked(held.filter("x IS NOT NULL"), "_order")
    b = F.floor(F.col("rank") / block).cast("bigint")
    values = places.groupBy("who", b.alias("b"), F.floor((F.col("rank") - b * block) / PIECE).cast("bigint").alias("place")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "x"))), lambda v: v["x"]).alias("v"))
    # a block of values goes over every chunk, so chunks of a large group are large too; a few more than all draws, for those that are not accepted
    size = F.greatest(F.lit(draws - draws % 2), 16 * (F.col("n") + F.col("n") % 2)).cast("bigint")
    number = F.ceil(resamples * F.col("n") * (1 + 4 * F.col("n") / float(1 << 32)) / size) + 1
    chunks = sizes.filter("n > 0").withColumn("size", size).select("who", "n", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), number.cast("bigint") - 1)).alias("chunk"))
    who = T.StructField("who", T.StructType([rows.schema[by]]))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since small rows of much work would be put together

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sum(map(len, slices(seed, n, c, d))) for n, c, d in zip(*(b.column(x).to_pylist() for x in ("n", "chunk", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "found"])

    longs = [T.StructField(c, T.LongType()) for c in ("n", "size", "chunk", "found")]
    dealt = chunks.repartition(tasks, "who", "chunk").mapInArrow(counted, T.StructType([who, *longs]))
    before = F.coalesce(F.sum("found").over(Window.partitionBy("who").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = settled(dealt.withColumn("before", before))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's pieces come before its chunks."""
        v = np.empty(block)
        for rows in batches:
            for i, (place, n, c, d, begin, at) in enumerate(zip(*(rows.column(x).to_pylist() for x in ("place", "n", "chunk", "size", "before", "b")), strict=True)):
                if place >= 0:
                    piece = rows.column("v")[i].values.to_numpy()
                    v[place * PIECE : place * PIECE + len(piece)] = piece
                    continue
                first, low, length = begin // n, at * block, min(block, n - at * block)
                total, met = np.zeros(0), False
                for index in slices(seed, n, c, d):
                    index = index[: max(resamples * n - begin, 0)]
                    if not len(index):
                        continue
                    mine = np.flatnonzero((index >= low) & (index < low + length))
                    more = np.bincount((begin + mine) // n - first, v[index[mine] - low], minlength=len(total))
                    more[: len(total)] += total
                    total, met, begin = more, met or len(mine) > 0, begin + len(index)
                if met:
                    yield pa.RecordBatch.from_arrays([rows.column("who").take(pa.array([i] * len(total))), pa.array(np.arange(first, first + len(total))), pa.array(total)], names=["who", "resample", "total"])

    # the tasks that share the chunks of a group each take every block's pieces once
    parts = F.least(F.lit(PARTS).cast("bigint"), number.cast("bigint"))
    none = F.lit(None).cast("bigint")
    pieces = values.join(sizes.select("who", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")), "who").select("who", "b", "part", "place", "v", *(none.alias(c) for c in ("n", "chunk", "size", "before")))
    lasts = F.floor((F.col("n") - 1) / block).cast("bigint")
    asked = dealt.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), lasts))).select("who", "b", (F.col("chunk") % parts).alias("part"), F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("array<double>").alias("v"), "n", "chunk", "size", "before")
    laid = pieces.unionAll(asked).repartition(tasks, "who", "b", "part").sortWithinPartitions("who", "b", "part", F.col("place") < 0, "place", "chunk")
    sums = laid.mapInArrow(summed, T.StructType([who, T.StructField("resample", T.LongType()), T.StructField("total", T.DoubleType())]))
    means = sums.groupBy("who", "resample").agg(F.sum("total").alias("total")).join(sizes, "who").select("who", (F.col("total") / F.col("n")).alias("m"))
    ends = means.groupBy("who").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sizes.join(ends, "who", "left").select(f"who.{by}", "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
