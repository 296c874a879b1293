"""Convolution of signals with responses of any length, cut into blocks on both sides.

A block of the signal and one of the response give, by one FFT of twice the
block, the share that both have in two blocks of the result; the shares of a
block are added up. So neither a signal nor a response is ever whole in a task.
Only blocks meet whose shares begin before the signal's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8192


def blocks(rows: DataFrame, value: str, block: int) -> DataFrame:
    """(who, block, k, x): the places and values of each block, in any order."""
    at = F.floor(F.col("idx") / block).cast("bigint")
    wide = rows.groupBy(F.struct("id").alias("who"), at.alias("block")).agg(F.collect_list(F.struct((F.col("idx") - at * block).cast("int").alias("k"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))).alias("x"))
    return wide.select("who", "block", F.col("x.k").alias("k"), F.col("x.x").alias("x"))


def convolve(signals: DataFrame, responses: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, idx, y): signals (id, idx, x) convolved with the responses (id, idx, h) of their ids, as long as the signals.

    Responses without a column id are one for all signals, whose blocks are never
    repeated for each id. idx counts from 0; what is missing, or null, is 0, and
    of values that repeat an idx the sum counts. A signal without a response is
    left out. A null id is an id of its own. An empty table gives an empty one.
    """
    shared = "id" not in responses.columns
    ends = signals.groupBy(F.struct("id").alias("who")).agg(F.max("idx").alias("last"))
    x = blocks(signals, "x", block).join(ends, "who")
    h = blocks(responses.withColumn("id", F.lit(0)) if shared else responses, "h", block).select("who", F.col("block").alias("hb"), F.col("k").alias("hk"), F.col("x").alias("h"))
    begins = (F.col("block") + F.col("hb")) * block <= F.col("last")
    pairs = x.join(h.drop("who"), begins) if shared else x.join(h, "who").filter(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dense(k, v) -> np.ndarray:
            out = np.zeros(block)
            np.add.at(out, k.values.to_numpy(), v.values.to_numpy())
            return out

        most = max(1, (1 << 20) // block)  # rows whose shares are held at once
        for b in (b.slice(a, most) for b in batches for a in range(0, b.num_rows, most)):
            at = b.column("block").to_numpy() + b.column("hb").to_numpy()
            rows, places, out = [], [], []
            for i, (xk, xv, hk, hv, last) in enumerate(zip(*(b.column(c) for c in ("k", "x", "hk", "h")), b.column("last").to_numpy(), strict=True)):
                y = np.fft.irfft(np.fft.rfft(dense(xk, xv), 2 * block) * np.fft.rfft(dense(hk, hv), 2 * block), 2 * block)
                for part in (0, 1):
                    if (at[i] + part) * block <= last:
                        rows.append(i)
                        places.append(int(at[i]) + part)
                        out.append(y[part * block : (part + 1) * block])
            each = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("who").take(each), pa.array(places, pa.int64()), b.column("last").take(each), pa.array(out, pa.list_(pa.float64()))], names=["who", "block", "last", "y"])

    who = T.StructField("who", T.StructType([signals.schema["id"]]))
    kind = T.StructType([who, T.StructField("block", T.LongType()), T.StructField("last", T.LongType()), T.StructField("y", T.ArrayType(T.DoubleType()))])
    needed = pairs.select("who", "block", "k", "x", "hb", "hk", "h", F.col("last").cast("bigint").alias("last"))
    shares = needed.mapInArrow(run, kind).groupBy("who", "block").agg(F.max("last").alias("last"), F.collect_list("y").alias("y"))
    shares = shares.withColumn("n", F.least(F.lit(block), F.col("last") + 1 - F.col("block") * block).cast("int")).filter("n > 0")
    total = F.aggregate("y", F.array_repeat(F.lit(0.0), block), lambda a, s: F.zip_with(a, s, lambda p, q: p + q))
    out = shares.select("who.id", "block", F.posexplode(F.slice(total, F.lit(1), F.col("n"))).alias("k", "y"))
    return out.select("id", (F.col("block") * block + F.col("k")).alias("idx"), "y")
