"""Scalar and array expressions on signals, from built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = 0.95
CRM_BOUND = 3.0


def rms(x: Column) -> Column:
    """Aggregate: root of the mean square, 0 for no rows."""
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def log10(x: Column) -> Column:
    """log10 with -infinity for 0, of which Spark's own has null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def db(x: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def level_db(x: Column) -> Column:
    """Aggregate: level of a block, -100 for no rows; adds its floor instead of clamping to it."""
    return F.coalesce(20 * F.log10(F.sqrt(F.avg(x * x)) + 1e-10), F.lit(-100.0))


def to_mono(frames: Column) -> Column:
    """Mean over the channels of each of an array of frames."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda a, v: a + v) / F.size(f))


def once(value: Column, use) -> Column:
    """use(value), value being worked out once and not for each element of the lambdas in use."""
    return F.get(F.transform(F.array(value), use), 0)


def peak_normalize(samples: Column, target: float = PEAK) -> Column:
    peak = F.array_max(F.transform(samples, F.abs))
    return once(peak, lambda p: F.when(p > 0, F.transform(samples, lambda v: v * (target / p))).otherwise(samples))


def num_frames(n: Column, n_fft: int = 512, hop: int = 256) -> Column:
    return F.when(n <= 0, F.lit(0)).otherwise(F.floor((F.lit(n_fft - hop - 1) + n) / hop) + 1).cast("bigint")


def flatness(power: Column) -> Column:
    """Spectral flatness: geometric over arithmetic mean."""
    n = F.size(power)
    logs = F.aggregate(power, F.lit(0.0), lambda a, p: a + F.log(F.greatest(p, F.lit(1e-12))))
    return F.exp(logs / n) / (F.aggregate(power, F.lit(0.0), lambda a, p: a + p) / n + 1e-12)


def compress(m: Column, power: float = 0.3) -> Column:
    return F.pow(F.greatest(m, F.lit(1e-8)), F.lit(power))


def decompress(m: Column, power: float = 0.3) -> Column:
    return F.pow(F.greatest(m, F.lit(0.0)), F.lit(1 / power))


def c_abs(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def c_mul(a: Column, b: Column) -> Column:
    """Product of two structs (re, im)."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def apply_mask(spec: Column, mask: Column, bound: float = CRM_BOUND) -> Column:
    """Complex ratio mask: structs (re, im); the mask is bounded by tanh."""
    soft = F.struct((bound * F.tanh(mask["re"] / bound)).alias("re"), (bound * F.tanh(mask["im"] / bound)).alias("im"))
    return c_mul(spec, soft)


def half_exp1(nu: Column) -> Column:
    """Half the exponential integral E1, by a piecewise fit. The coefficients are fixed values of the published approximation."""
    e1 = F.when(nu < 0.1, -2.3 * F.log10(nu) - 0.6).when(nu < 1, -1.544 * F.log10(nu) + 0.166).otherwise(F.pow(F.lit(10.0), -0.53 * nu - 0.26))
    return 0.5 * e1


def hann(n: Column, size: int) -> Column:
    """The periodic Hann window's n-th value, under a root: at half overlap its squares add up to one."""
    return F.sqrt(0.5 - 0.5 * F.cos(2 * math.pi * n / size))


def dft(frame: Column, size: int) -> Column:
    """Array of structs (re, im) of the bins 0 to size / 2 of a real frame."""
    place = F.sequence(F.lit(0), F.lit(size - 1))

    def part(k: Column, f, sign: int) -> Column:
        return F.aggregate(F.zip_with(frame, place, lambda v, n: v * f(2 * math.pi * k * n / size)), F.lit(0.0), lambda a, v: a + sign * v)

    return F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: F.struct(part(k, F.cos, 1).alias("re"), part(k, F.sin, -1).alias("im")))


def to_array(order: str, x: str) -> Column:
    """Aggregate: the x of a group as an array, in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, x))), lambda s: s[x])
