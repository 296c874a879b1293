"""Ordered recursions on signals: closed forms over windows where they exist, else one fold over the ordered array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_tracker(sig: DataFrame, length: int) -> DataFrame:
    """(id, idx, low): the smallest value of the block before and of this block so far.

    Sample n > 0 is update n - 1 and lies in block (n - 1) div length; sample 0
    belongs to block 0. Two running minima, no recursion.
    """
    block = F.greatest(F.floor((F.col("idx") - 1) / length), F.lit(0)).cast("bigint")
    blocks = sig.withColumn("block", block)
    here = Window.partitionBy("id", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.groupBy("id", F.col("block").alias("b")).agg(F.min("x").alias("before")).withColumn("block", F.col("b") + 1).drop("b")
    return blocks.withColumn("so_far", F.min("x").over(here)).join(ends, ["id", "block"], "left").select("id", "idx", F.least("so_far", "before").alias("low"))


def fold(samples: Column, start: Column, step, chunk: int = 256) -> Column:
    """All states of a recursion over an array: state = step(state, value); the first state is step(start, first value).

    States are gathered chunk by chunk: one growing array would be copied with each value.
    """

    def states_of(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda a, v: F.concat(a, F.array(step(F.element_at(a, -1), v))), lambda a: F.slice(a, F.lit(2), F.size(a)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(samples), F.lit(1)), F.lit(chunk))
    parts = F.transform(starts, lambda at: F.slice(samples, at, F.lit(chunk)))
    done = F.aggregate(parts, F.array(F.array(start)), lambda a, part: F.concat(a, F.array(states_of(F.element_at(F.element_at(a, -1), -1), part))), lambda a: F.slice(a, F.lit(2), F.size(a)))
    return F.flatten(done)


def gate_coefficients(frame_s: float = 0.016, attack_s: float = 0.005, release_s: float = 0.2) -> tuple[float, float]:
    return math.exp(-frame_s / attack_s), math.exp(-frame_s / release_s)


def gate_step(frame_s: float = 0.016, floor_db: float = -20.0):
    """Smoothing of a gate that opens fast and closes slowly: takes the gate and whether there is speech."""
    attack, release = gate_coefficients(frame_s)
    closed = 10 ** (floor_db / 20)

    def step(gate: Column, speech: Column) -> Column:
        target = F.when(speech, F.lit(1.0)).otherwise(F.lit(closed))
        a = F.when(target > gate, F.lit(attack)).otherwise(F.lit(release))
        return a * gate + (1 - a) * target

    return step


def wiener_step(dd: float = 0.98, least: float = 10**-2.5, low: float = 10 ** (-18 / 20)):
    """Decision-directed Wiener gain of one bin: a struct (gain, gamma, first) and a struct (power, noise)."""

    def step(s: Column, v: Column) -> Column:
        gamma = v["power"] / (v["noise"] + 1e-12)
        ml = F.greatest(gamma - 1, F.lit(0.0))
        xi = F.greatest(F.when(s["first"], ml).otherwise(dd * s["gain"] * s["gain"] * s["gamma"] + (1 - dd) * ml), F.lit(least))
        gain = F.least(F.greatest(xi / (1 + xi), F.lit(low)), F.lit(1.0))
        return F.struct(gain.alias("gain"), gamma.alias("gamma"), F.lit(False).alias("first"))

    return step


def subtraction_gain(power: Column, noise: Column, snr_db: Column, beta: float = 0.02, low: float = 10 ** (-18 / 20)) -> Column:
    """Spectral subtraction with an over-subtraction that falls as the frame's SNR rises."""
    alpha = 4 - 0.15 * F.least(F.greatest(snr_db, F.lit(-5.0)), F.lit(20.0))
    gain = F.sqrt(F.greatest(power - alpha * noise, beta * noise) / (power + 1e-12))
    return F.least(F.greatest(gain, F.lit(low)), F.lit(1.0))


def backoff(gain: Column, snr_db: Column, start: float = 2.0, end: float = 14.0) -> Column:
    """Lets the gain go to 1 as the frame's SNR goes from start to end."""
    t = F.least(F.greatest((snr_db - start) / (end - start), F.lit(0.0)), F.lit(1.0))
    return gain + (1 - gain) * t


def states(sig: DataFrame, x: Column, start: Column, step, name: str = "state") -> DataFrame:
    """(id, idx, state) of a recursion over each signal in order; a signal is one array of one task."""
    wide = sig.withColumn("_x", x).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "_x"))).alias("v"))
    done = wide.select("id", F.posexplode(fold(F.transform("v", lambda s: s["_x"]), start, step)))
    return done.select("id", F.col("pos").cast("bigint").alias("idx"), F.col("col").alias(name))
