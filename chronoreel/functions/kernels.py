"""Filter kernels and sample arithmetic as array expressions: sinc and Lanczos kernels, resampling, whole-number taps, mixing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinc_kernel(size: int, cutoff: float) -> list[float]:
    """A low-pass kernel: a sinc of cutoff (a share of the sampling rate) under a Hamming window, with sum 1."""
    half = size // 2
    taps = [2 * math.pi * cutoff if i == half else math.sin(2 * math.pi * cutoff * (i - half)) / (i - half) * (0.54 - 0.46 * math.cos(2 * math.pi * i / size)) for i in range(size)]
    return [t / sum(taps) for t in taps]


def convolve(samples: Column, kernel: list[float]) -> Column:
    """Each place at which the whole kernel lies on samples: the sum of products; an empty array where samples are fewer."""
    taps = F.array(*map(F.lit, kernel))
    at = F.sequence(F.lit(0), F.greatest(F.size(samples) - len(kernel), F.lit(0)))
    out = F.transform(at, lambda i: F.aggregate(F.arrays_zip(F.slice(samples, i + 1, len(kernel)).alias("x"), taps.alias("k")), F.lit(0.0), lambda s, e: s + e["x"] * e["k"]))
    return F.when(F.size(samples) >= len(kernel), out).otherwise(F.array().cast("array<double>"))


def lanczos(x: Column, a: int = 3) -> Column:
    """The Lanczos kernel of a lobes: 0 outside, 1 at 0."""
    p = F.lit(math.pi)
    inside = (a * F.sin(p * x) * F.sin(p * x / a)) / (p * p * x * x)
    return F.when(F.abs(x) > a, 0.0).when(x == 0, 1.0).otherwise(inside)


def resample(samples: Column, from_rate: int, to_rate: int) -> Column:
    """samples at another rate: from sample 3 on, each output place takes three neighbours on either side by Lanczos weights that add up to 1; a
    place within a thousandth behind a sample takes it as it is. Arrays of six samples or fewer give none."""
    step = from_rate / to_rate
    n = F.size(samples)
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - 6) / step).cast("int") + 1))

    def at(i: Column) -> Column:
        x = 3 + i * step
        p = F.floor(x).cast("int")
        weights = {k: lanczos((p + k).cast("double") - x) for k in (-2, -1, 0, 1, 2, 3)}
        total, mixed = F.lit(0.0), F.lit(0.0)
        for k, w in weights.items():
            total, mixed = total + w, mixed + w * F.get(samples, p + k)
        return F.when(p >= n - 3, F.lit(None)).when(p - x < -0.001, mixed / total).otherwise(F.get(samples, p))

    return F.when(n > 6, F.array_compact(F.transform(places, at))).otherwise(F.array().cast("array<double>"))


def whole_taps(taps: Column, bits: int) -> Column:
    """Taps as whole numbers with sum 2**bits: each scaled one is cut down, and those with the largest remainders get one more (the first of equals)."""
    one = 1 << bits
    total = F.aggregate(taps, F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform(taps, lambda x, i: F.struct(F.floor(x * one / total).cast("long").alias("w"), (x * one / total - F.floor(x * one / total)).alias("r"), i.alias("i")))
    short = one - F.aggregate(scaled, F.lit(0).cast("long"), lambda s, e: s + e["w"])
    ranked = F.transform(F.array_sort(F.transform(scaled, lambda e: F.struct((-e["r"]).alias("r"), e["i"].alias("i"), e["w"].alias("w")))), lambda e, k: F.struct(e["i"].alias("i"), (e["w"] + (k < short).cast("long")).alias("w")))
    return F.transform(F.array_sort(ranked), lambda e: e["w"])


def mix(contributors: list[Column], coefficients: list[float], muted: list[bool] | None = None) -> Column:
    """One sample of a mix: the only contributor times its coefficient as it is; of several the sum less the product, bounded to [-1, 1]. As a 16-bit
    number (a full 1.0 of one contributor wraps). Null contributors are silent; without any the mix is 0."""
    live = [(c, k) for c, k, m in zip(contributors, coefficients, muted or [False] * len(contributors), strict=True) if not m and k]
    parts = [F.coalesce(c, F.lit(0.0)) * k for c, k in live]
    total, product = F.lit(0.0), F.lit(1.0)
    for p in parts:
        total, product = total + p, product * p
    level = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total - product)) if len(parts) > 1 else total
    return F.floor(level * 32768).cast("long").bitwiseAND(0xFFFF)


def next_power_of_two(x: Column) -> Column:
    """The least power of two not below x; 1 for x under 2."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(x.cast("long") - 1, F.lit(0)))) - (x.cast("long") <= 1).cast("int"))


def wrap(x: Column, size: int) -> Column:
    """x in [0, size) around a ring."""
    return F.pmod(x, F.lit(size))


def reverse_bits(x: Column) -> Column:
    """A byte's bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x.cast("long")), 8, "0")), 2, 10).cast("int")


def odd_sign(x: Column) -> Column:
    """1 for negatives, 0 otherwise."""
    return (x < 0).cast("int")


def whole_int(x: Column) -> Column:
    """A long as an int; null where it doesn't fit."""
    return F.when(x.between(-(2**31), 2**31 - 1), x.cast("int"))


def rotate(a: Column, n: int) -> Column:
    """An array moved n places to the left, around its end."""
    k = F.pmod(F.lit(n), F.greatest(F.size(a), F.lit(1)))
    return F.concat(F.slice(a, k + 1, F.size(a)), F.slice(a, F.lit(1), k))


def swap(a: Column, i: int, j: int) -> Column:
    """An array with two places (from 0) exchanged."""
    return F.transform(a, lambda x, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(x))


def permute(a: Column, order: list[int]) -> Column:
    return F.array(*(F.get(a, F.lit(i)) for i in order))


def write_bits(fields: list[tuple[Column, int]]) -> Column:
    """Fields of (value, width) one after the other as bytes, the last one filled with zeros; values are cut to their width."""
    bits = F.concat(*(F.lpad(F.bin(v.cast("long").bitwiseAND((1 << n) - 1)), n, "0") for v, n in fields))
    width = -(-sum(n for _, n in fields) // 4) * 4
    padded = F.rpad(bits, -(-width // 8) * 8, "0")
    parts = [F.lpad(F.conv(F.substring(padded, 1 + 8 * i, 8), 2, 16), 2, "0") for i in range(-(-width // 8))]
    return F.unhex(F.concat(*parts))


def scale_depth(x: Column, bits: int, to_bits: int) -> Column:
    """A signed sample of bits in another depth: shifted up, or down towards minus infinity."""
    return F.call_function("shiftleft", x, F.lit(to_bits - bits)) if to_bits >= bits else F.call_function("shiftright", x, F.lit(bits - to_bits))
