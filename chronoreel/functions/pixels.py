"""Pixel and block kernels as integer column arithmetic. Planes are arrays of ints from 0 to 255 in row order unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import clip

#: Fixed values of the 8-bit studio-range conversion, in 1/256ths.
Y_SCALE, V_TO_R, U_TO_G, V_TO_G, U_TO_B = 298, 409, 100, 208, 516
R_TO_Y, G_TO_Y, B_TO_Y = 66, 129, 25
R_TO_U, G_TO_U, B_TO_U = -38, -74, 112
R_TO_V, G_TO_V, B_TO_V = 112, -94, -18


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """struct<r, g, b> from studio-range y, u, v (0 to 255)."""
    c, d, e = y - 16, u - 128, v - 128
    level = lambda x: clip(F.shiftright(x + 128, 8), 0, 255).cast("int")
    return F.struct(level(c * Y_SCALE + e * V_TO_R).alias("r"), level(c * Y_SCALE - d * U_TO_G - e * V_TO_G).alias("g"), level(c * Y_SCALE + d * U_TO_B).alias("b"))


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Column:
    """struct<y, u, v> in studio range."""
    level = lambda x, base: clip(F.shiftright(x + 128, 8) + base, 0, 255).cast("int")
    return F.struct(
        level(r * R_TO_Y + g * G_TO_Y + b * B_TO_Y, 16).alias("y"), level(r * R_TO_U + g * G_TO_U + b * B_TO_U, 128).alias("u"), level(r * R_TO_V + g * G_TO_V + b * B_TO_V, 128).alias("v")
    )


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two blocks."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def ssd(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def psnr(squared_error: Column, n: Column) -> Column:
    """10 log10(255^2 n / error); null for equal blocks."""
    return F.when(squared_error > 0, F.log10(F.lit(65025.0) * n / squared_error) * 10)


def block_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def subsample_pairs(a: Column) -> Column:
    """Average of each pair, rounded up at a half."""
    return F.transform(F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1), lambda i: F.shiftright(F.get(a, i * 2) + F.get(a, i * 2 + 1) + 1, 1))


def fir(a: Column, taps: list[int], shift: int = 0) -> Column:
    """Valid part of the convolution with integer taps, shifted right with rounding."""
    n = F.size(a) - len(taps) + 1

    def at(i: Column) -> Column:
        total = sum(F.get(a, i + k) * t for k, t in enumerate(taps))
        return F.shiftright(total + (1 << shift >> 1), shift) if shift else total

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>"))


#: Fixed bicubic taps at quarter steps in 1/128ths, four for each phase.
BICUBIC = [[0, 128, 0, 0], [-9, 111, 29, -3], [-8, 72, 72, -8], [-3, 29, 111, -9]]


def resample4(a: Column, step: int, n_out: int) -> Column:
    """n_out samples at steps of step quarter samples, four taps each, edges repeated; 7-bit fixed point."""
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        pos = i * step
        base, phase = F.shiftright(pos, 2), pos.bitwiseAND(F.lit(3))
        taps = F.get(F.array(*(F.array(*map(F.lit, row)) for row in BICUBIC)), phase)
        total = sum(F.get(a, clip(base + (k - 1), 0, last)) * F.get(taps, F.lit(k)) for k in range(4))
        return F.shiftright(total + 64, 7)

    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), at)


def hadamard8(a: Column) -> Column:
    """Unnormalised Walsh-Hadamard transform of eight ints."""
    def step(prev: Column, h: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i.bitwiseAND(F.lit(h)) == 0, F.get(prev, i) + F.get(prev, i + h)).otherwise(F.get(prev, i - h) - F.get(prev, i)))

    for h in (1, 2, 4):
        a = F.element_at(F.transform(F.array(a), lambda x: step(x, h)), 1)  # noqa: B023
    return a


def integer_transform4(a: Column) -> Column:
    """The 4-point integer core transform of four ints."""
    x = [F.get(a, F.lit(i)) for i in range(4)]
    s0, s1, d0, d1 = x[0] + x[3], x[1] + x[2], x[0] - x[3], x[1] - x[2]
    return F.array(s0 + s1, d0 * 2 + d1, s0 - s1, d0 - d1 * 2)


def crop(a: Column, width: int, x: int, y: int, w: int, h: int) -> Column:
    """The w by h window at (x, y) of a plane of that width."""
    return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda r: F.slice(a, r * width + (x + 1), F.lit(w))))


def first_difference(a: Column, b: Column) -> Column:
    """Position of the first unlike pixel, null if there is none."""
    unlike = F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q))
    place = F.array_position(unlike, True)
    return F.when(place > 0, place - 1)


def cosine_basis(n: int = 8, bits: int = 12) -> list[list[int]]:
    """The n-point cosine transform as whole numbers in 1/2**bits: row k, column i."""
    import math

    rows = []
    for k in range(n):
        scale = math.sqrt((1 if k == 0 else 2) / n) * (1 << bits)
        rows.append([math.floor(scale * math.cos((2 * i + 1) * k * math.pi / (2 * n)) + 0.5) for i in range(n)])
    return rows


def dct8x8(a: Column, inverse: bool = False, bits: int = 12) -> Column:
    """Two-dimensional cosine transform of 64 ints in row order, rounded after each pass."""
    basis = F.array(*(F.array(*map(F.lit, row)) for row in cosine_basis(8, bits)))
    half = 1 << (bits - 1)

    def one_pass(block: Column, table: Column, along_rows: bool) -> Column:
        def at(p: Column) -> Column:
            r, c = F.shiftright(p, 3), p.bitwiseAND(F.lit(7))
            line, k = (r, c) if along_rows else (c, r)
            total = sum(
                F.get(block, line * 8 + i if along_rows else line + 8 * i) * (F.get(F.get(table, F.lit(i)), k) if inverse else F.get(F.get(table, k), F.lit(i)))
                for i in range(8)
            )
            return F.shiftright(total + half, bits)

        return F.transform(F.sequence(F.lit(0), F.lit(63)), at)

    once = F.transform(F.array(F.struct(a.alias("a"), basis.alias("t"))), lambda s: F.struct(one_pass(s["a"], s["t"], True).alias("a"), s["t"].alias("t")))
    return F.element_at(F.transform(once, lambda s: one_pass(s["a"], s["t"], False)), 1)


def motion_search(block: Column, window: Column, width: int, size: int, reach: int) -> Column:
    """The shift (dx, dy) of a size by size block in a window of that width with the least sum of absolute differences; the block's own
    place is (reach, reach) in the window, ties go to the first in row order."""
    tries = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            tries.append(F.struct(sad(block, crop(window, width, reach + dx, reach + dy, size, size)).alias("sad"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")))
    return F.array_min(F.array(*tries))
