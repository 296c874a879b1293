"""Recursions over signals of any length as scans of associative maps.

What a frame does to the state of a recursion is a map; maps compose, so a
signal is cut into blocks of frames that many tasks compose at once. The blocks'
maps are rows of a shorter signal, whose scan, the same way, gives the state at
which each block is entered; from there a second pass over the blocks fills in
all states. No task holds more than a block, and no signal is ever one row.

AFFINE maps, s -> a * s + b, serve averages whose weights the input gives; z is
what they make of a state that is still null. A TABLE maps the states of a
finite machine, counted from 0, by one lookup.

Rows have id and idx, the frames of an id counted from 0; they may come in any
order. A null id is an id of its own. Frames left out do nothing; of frames that
repeat an idx each has its turn, in the order of their values. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recursive import fold, gate_coefficients

#: Frames of a block, and blocks of a block of the shorter signal.
BLOCK = 4096


@dataclass(frozen=True)
class Maps:
    """identity(), compose(first, then), apply(state, map)."""

    identity: Callable[[], Column]
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


def affine(a: Column | float, b: Column | float, z: Column | None = None) -> Column:
    """The map s -> a * s + b; a null state becomes z, or stays null."""
    return F.struct(F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"), (F.lit(None) if z is None else z).cast("double").alias("z"))


AFFINE = Maps(
    identity=lambda: affine(1.0, 0.0),
    compose=lambda f, g: affine(f["a"] * g["a"], g["a"] * f["b"] + g["b"], F.when(f["z"].isNull(), g["z"]).otherwise(g["a"] * f["z"] + g["b"])),
    apply=lambda s, m: F.when(s.isNull(), m["z"]).otherwise(m["a"] * s + m["b"]),
)


def tables(states: int) -> Maps:
    """Maps of the states 0 to states - 1, as arrays; a null state stays null, as does one without an entry."""
    return Maps(
        identity=lambda: F.sequence(F.lit(0), F.lit(states - 1)),
        compose=lambda f, g: F.transform(f, lambda s: F.get(g, s)),
        apply=lambda s, m: F.get(m, s),
    )


def packed(rows: DataFrame, value: Column, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(who, block, v): the frames of each block in order, as structs (idx, m, ...). who is a struct of the id: a null one has equals too."""
    frame = F.struct("idx", value.alias("m"), *keep)
    return rows.groupBy(F.struct("id").alias("who"), F.floor(F.col("idx") / block).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(frame)).alias("v"))


def entered(blocks: DataFrame, maps: Maps, start: Column, most: int, block: int = BLOCK) -> DataFrame:
    """(who, block, entry): the state at which each row of blocks (who, block, m) is entered. most: the largest block."""
    wide = packed(blocks.select(F.col("who.id").alias("id"), F.col("block").alias("idx"), "m"), F.col("m"), block=block)
    if most < block:  # an id's rows are one block
        met = wide.withColumn("entry", start)
    else:
        met = wide.join(entered(wide.select("who", "block", _total(maps, lambda m: m).alias("m")), maps, start, most // block, block), ["who", "block"])
    return _filled(met, maps, lambda m: m, before=True).select(F.struct("id").alias("who"), F.col("idx").alias("block"), F.col("state").alias("entry"))


def _total(maps: Maps, as_map: Callable[[Column], Column]) -> Column:
    return F.aggregate("v", maps.identity(), lambda f, x: maps.compose(f, as_map(x["m"])))


def _filled(blocks: DataFrame, maps: Maps, as_map: Callable[[Column], Column], keep: Sequence[str] = (), before: bool = False) -> DataFrame:
    """The rows of blocks (who, v, entry) with the state behind each, or before it."""
    states = fold(F.transform("v", lambda x: x["m"]), F.col("entry"), lambda s, m: maps.apply(s, as_map(m)))
    if before:
        states = F.concat(F.array("entry"), F.slice(states, 1, F.size("v") - 1))
    rows = blocks.select("who.id", F.explode(F.arrays_zip(F.col("v").alias("v"), states.alias("state"))).alias("x"))
    return rows.select("id", *(F.col("x")["v"][c].alias(c) for c in ("idx", *keep)), F.col("x")["state"].alias("state"))


def scan(rows: DataFrame, value: Column, maps: Maps, start: Column, as_map: Callable[[Column], Column] = lambda m: m, keep: Sequence[str] = (), name: str = "state", block: int = BLOCK) -> DataFrame:
    """(id, idx, keep..., name): the state behind every frame, from `start` on; as_map(value) is a frame's map."""
    most = rows.agg(F.max("idx")).first()[0] or 0
    frames = packed(rows, value, keep, block)
    begun = entered(frames.select("who", "block", _total(maps, as_map).alias("m")), maps, start, most // block, block)
    return _filled(frames.join(begun, ["who", "block"]), maps, as_map, keep).withColumnRenamed("state", name)


def gate(rows: DataFrame, speech: Column, frame_s: float = 0.016, floor_db: float = -20.0, block: int = BLOCK) -> DataFrame:
    """(id, idx, gate): a gate that opens fast and closes slowly, open at first. It never leaves what lies between its targets, so the target alone says which weight holds."""
    attack, release = gate_coefficients(frame_s)
    closed = 10 ** (floor_db / 20)
    opens = F.coalesce(speech, F.lit(False))
    a, target = F.when(opens, F.lit(attack)).otherwise(F.lit(release)), F.when(opens, F.lit(1.0)).otherwise(F.lit(closed))
    return scan(rows, affine(a, (1 - a) * target), AFFINE, F.lit(1.0), name="gate", block=block)


def level(rows: DataFrame, db: Column, keep: float = 0.92, least_db: float = -80.0, block: int = BLOCK) -> DataFrame:
    """(id, idx, level): an exponential mean of levels that leaves out silent frames; null before the first loud one, which sets it."""
    loud = F.coalesce(db > least_db, F.lit(False))
    value = affine(F.when(loud, F.lit(keep)).otherwise(F.lit(1.0)), F.when(loud, (1 - keep) * db).otherwise(F.lit(0.0)), F.when(loud, db))
    return scan(rows, value, AFFINE, F.lit(None).cast("double"), name="level", block=block)


def noise(rows: DataFrame, power: str = "power", smooth: str = "smooth", floor: str = "floor", alpha_p: float = 0.2, alpha_d: float = 0.95, delta: float = 5.0, block: int = BLOCK) -> DataFrame:
    """(id, idx, p, noise): presence-controlled noise averaging of one bin; the first frame sets the floor. Two scans: presence first, whose result gives the weights of the second."""
    present = F.when(F.col(smooth) / F.greatest(F.col(floor), F.lit(1e-12)) > delta, F.lit(1.0)).otherwise(F.lit(0.0))
    p = scan(rows, affine(alpha_p, (1 - alpha_p) * present, F.lit(0.0)), AFFINE, F.lit(None).cast("double"), keep=(power,), name="p", block=block)
    a = alpha_d + round(1 - alpha_d, 12) * F.col("p")
    out = scan(p, affine(a, (1 - a) * F.col(power), F.col(power)), AFFINE, F.lit(None).cast("double"), keep=("p",), name="noise", block=block)
    return out.select("id", "idx", "p", "noise")


def hysteresis_tables(onset: int = 2, hang: int = 12) -> tuple[list[tuple[int, int, bool]], list[list[int]]]:
    """The machine's states (run of candidates, at most `onset`; hang; active), and the next state of each for a frame that is no candidate and for one that is. The first state is the start."""
    names = [(run, held, active) for run in range(onset + 1) for held in range(hang + 1) for active in (False, True)]
    place = {s: k for k, s in enumerate(names)}

    def step(s: tuple[int, int, bool], candidate: bool) -> tuple[int, int, bool]:
        run, held, active = s
        if candidate:
            run = min(run + 1, onset)
            return (run, hang, True) if run >= onset else (run, held, active)
        return (0, held - 1, active) if held > 0 else (0, 0, False)

    return names, [[place[step(s, candidate)] for s in names] for candidate in (False, True)]


def hysteresis(rows: DataFrame, candidate: Column, onset: int = 2, hang: int = 12, block: int = BLOCK) -> DataFrame:
    """(id, idx, hang, active): activity begins with `onset` candidates in a row and lasts `hang` frames longer than they do."""
    names, steps = hysteresis_tables(onset, hang)
    symbol = F.when(F.coalesce(candidate, F.lit(False)), 1).otherwise(0)
    # the tables are one literal, and a frame is only its symbol
    known = F.array(*(F.array(*map(F.lit, t)) for t in steps))
    out = scan(rows, symbol, tables(len(names)), F.lit(0), lambda k: F.get(known, k), block=block)
    return out.select("id", "idx", F.get(F.array(*(F.lit(h) for _, h, _ in names)), F.col("state")).alias("hang"), F.get(F.array(*(F.lit(a) for *_, a in names)), F.col("state")).alias("active"))


def next_segments(flags: np.ndarray, quiet: int, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the first speech from there on (the number of flags without any), and the place behind the segment that begins with it, -1 if that is not over yet."""
    n = len(flags)
    speech = np.flatnonzero(flags)
    # the least-th frame of speech, and from there the first frame that ends `quiet` silent ones
    k = max(least, 1) - 1
    enough = np.append(speech[k:], np.full(min(k, len(speech)), n))
    since = np.arange(n) - np.maximum.accumulate(np.where(flags, np.arange(n), -1)) if n else np.empty(0, np.int64)
    still = np.append(np.flatnonzero(since == max(quiet, 0)), n)
    last = np.minimum(still[np.searchsorted(still[:-1], enough)], speech + longest)
    which = np.searchsorted(speech, np.arange(n))
    return np.append(speech, n)[which], np.append(np.where(last < n, last + 1, -1), -1)[which]


def _left(flags: np.ndarray, size: int, quiet: int, least: int, longest: int) -> list[int]:
    """For each of a block's first places: entered idle there, at which place of the next block the machine is idle again; -1 if it is not."""
    starts, ends = next_segments(flags, quiet, least, longest)
    own = min(size, len(flags))
    left = [-1] * own + [0]
    for p, (start, end) in enumerate(zip(starts[:own][::-1].tolist(), ends[:own][::-1].tolist(), strict=True)):
        if start >= own:
            left[own - 1 - p] = 0
        elif end >= 0:
            left[own - 1 - p] = end - size if end >= size else left[min(end, own)]
    return left[: longest + 1]


def segments(frames: DataFrame, quiet: int = 30, least: int = 38, longest: int = 750, block: int = BLOCK) -> DataFrame:
    """(id, start, end) of the segments of speech of rows (id, idx, speech), idx from 0 without gaps.

    A segment begins with a frame of speech and ends once it has `least` of them
    and then `quiet` silent frames, or is longer than `longest`; one still open
    at the end of its signal is not given out. All that matters at a place is
    that the machine is idle there, and a segment has longest + 1 frames at most:
    so a block, with that many frames of the next, maps the places at its
    beginning where it may be entered idle to those of the next block. The maps
    compose as those of any finite machine; entered where they say, the blocks
    give out their segments.
    """
    size = max(block, longest + 2)
    at = F.floor(F.col("idx") / size).cast("bigint")
    early = (F.col("idx") - at * size < longest) & (at > 0)
    dealt = frames.select(F.struct("id").alias("who"), "idx", F.coalesce("speech", F.lit(False)).alias("speech"), F.explode(F.when(early, F.array(at - 1, at)).otherwise(F.array(at))).alias("block"))
    own = dealt.groupBy("who", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "speech"))), lambda x: x["speech"]).alias("flags"))
    who = T.StructField("who", T.StructType([frames.schema["id"]]))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [_left(x.values.to_numpy(zero_copy_only=False), size, quiet, least, longest) for x in b.column("flags")]
            yield pa.RecordBatch.from_arrays([b.column("who"), b.column("block"), pa.array(maps, pa.list_(pa.int32()))], names=["who", "block", "m"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int, int]] = []
            for i, (x, block, p) in enumerate(zip(b.column("flags"), b.column("block").to_pylist(), b.column("entry").to_pylist(), strict=True)):
                flags = x.values.to_numpy(zero_copy_only=False)
                starts, ends = next_segments(flags, quiet, least, longest)
                while p is not None and 0 <= p < min(size, len(flags)) and starts[p] < min(size, len(flags)) and ends[p] >= 0:
                    found.append((i, block * size + int(starts[p]), block * size + int(ends[p])))
                    p = int(ends[p])
            i, start, end = (pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays([b.column("who").take(i), start, end], names=["who", "start", "end"])

    maps = own.mapInArrow(mapped, T.StructType([who, T.StructField("block", T.LongType()), T.StructField("m", T.ArrayType(T.IntegerType()))]))
    most = frames.agg(F.max("idx")).first()[0] or 0
    begun = entered(maps, tables(longest + 1), F.lit(0), most // size, block)
    found = own.join(begun, ["who", "block"]).select("who", "block", "flags", "entry").mapInArrow(cut, T.StructType([who, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return found.select("who.id", "start", "end")
